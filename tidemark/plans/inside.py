"""Values that features smooth or scale, as columns of their own: a feature's queries, without its steps."""

from __future__ import annotations

from tidemark.plans import brokers, crosses, ladder, ticks
from tidemark.plans.feature import Columns, Feature
from tidemark.plans.ladder import LADDER
from tidemark.plans.ticks import T

_ALL: dict[str, Feature] = {f.name: f for part in (ticks, brokers, crosses, ladder) for f in part.FEATURES}


def raw(name: str, feature: str, value: str = "x") -> Columns:
    of = _ALL[feature]
    return Columns(f"{name}_column", f"what {feature} is made from", of.queries, ((name, value),), of.queries[-1][0], of.reads, False)


def day_of(name: str, feature: str, value: str) -> Columns:
    """The same, from the feature's own day before it is joined to daily bars."""
    of = _ALL[feature]
    return Columns(f"{name}_column", f"what {feature} is made from", of.queries[:-1], ((name, value),), of.queries[-2][0], of.reads, False)


def same(*names: str) -> tuple[Columns, ...]:
    return tuple(raw(f"raw_{n}", f"f_{n}") for n in names)


#: Sums of a feature's two parts, the market's leading net selling, and the mean jump of falls.
OBFUSCATION = Columns("raw_obfuscation_columns", "turns and uneven sizes of bins, and the market's leading net selling", (*_ALL["f_gt_information_design_obfuscation"].queries[:-1], ("d", "SELECT o.StockId, o.Date, hidden, sold FROM o LEFT JOIN five ON o.Date = five.Date")), (
    ("raw_obfuscation_index", "coalesce(hidden, 0.0)"), ("Top5_NetSell", "coalesce(sold, 0.0)"),
), "d", ("brokers", "ticks"), False)
DOWNTICKS = Columns("raw_downtick_columns", "mean jump of selling ticks", (T, LADDER), (("raw_mean_spread_downtick", "coalesce(avg(down), 0.0)"),), "ladder", ("ticks",))
TABLES = (
    *same("mixed_levy_gaussian_dispersion", "integer_level_density", "tick_entropy_rate", "vwap_gravity_pull", "tick_run_imbalance", "mac_kramers_moyal_error", "qit_incompatible_observables_product", "mhd_vortex_asymmetric_contraction", "lrt_fd_asymmetry", "qm_coarse_graining_loss_bias", "qit_athermal_free_energy"),
    raw("raw_momentum_continuity", "f_momentum_continuity", "coalesce(x, 0.5)"), raw("_newcomer_net_momentum", "f_newcomer_net_momentum"), day_of("raw_top10_boundary_buy", "f_stefan_boundary_sacrifice_ratio", "part"), day_of("raw_top10_baseline_buy", "f_super_invader_baseline_defense", "part"), OBFUSCATION, DOWNTICKS,
)
