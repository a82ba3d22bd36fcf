"""Personal data by weak supervision (operator 10): DataFrame functions only.

Patterns propose candidate spans. Labelers vote on each: a regex labeler (is the format strictly right), a gazetteer
labeler (does it name what such data name), a context labeler (cue words before it) and a border labeler (does it stand
by itself). Expectation-maximisation over the counts of vote patterns estimates how reliable each labeler is; its
posteriors train a naive Bayes classifier over votes, lengths and composition, which decides on added spans. Spans of
the four base kinds that pass their checks are always kept.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stored

#: Marks around matches; in a text they are first replaced by another private character, which no pattern matches.
OPEN, CLOSE, OTHER = "", "", ""
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"

# Base kinds in order, then added ones. A pattern never looks twice at the same character without
# need: runs are possessive, and a match starts where its run starts or where the last match ended.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "tel": r"(?<![0-9+.(-])\(?[0-9]{3}\)?[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "mailwords": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,63}(?:\x20?[\[(]dot[\])]\x20?[A-Za-z0-9-]{1,63}){1,4}",
}
KINDS = list(PATTERNS)
BASE = KINDS[:4]
#: What a text must hold for a pattern to be tried.
NEEDS = {
    "email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]", "tel": r"[0-9]{3}[\x20.-][0-9]{4}",
    "ssn": r"-[0-9]{2}-", "iban": r"[A-Z]{2}[0-9]{2}", "mailwords": r"[\[(]at[\])]",
}
ANY = "|".join(f"(?:{p})" for p in dict.fromkeys(NEEDS.values()))
#: Gazetteers: what a span of a kind names if it is real.
GAZETTEER = {
    "email": r"(?i)\.(?:com|org|net|edu|gov|info|io|de|fr|es|it|uk|eu|us|ch|at|nl)$", "ip": r"^(?!0|127|255)", "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6)", "phone": r"^\+[1-9]",
    "tel": r"^\(?[2-9]", "ssn": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)", "iban": r"^(?:AD|AT|BE|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HR|HU|IE|IT|LI|LT|LU|LV|MC|MT|NL|NO|PL|PT|RO|SE|SI|SK|SM)", "mailwords": r"(?i)(?:com|org|net|edu|de|fr|es)$",
}
#: Cue words before a span, for and against.
CUES = {
    "email": "mail|contact|write|address|correo", "ip": r"\bip\b|host|server|address|login|client", "card": "card|visa|master|credit|payment|tarjeta|karte|carte", "phone": r"phone|\btel|call|mobile|fax|whatsapp",
    "tel": r"phone|\btel|call|mobile|fax|whatsapp", "ssn": r"\bssn\b|social security", "iban": "iban|account|bank|konto|compte|cuenta", "mailwords": "mail|contact|write",
}
AGAINST = r"version|isbn|order|serial|figure|page|chapter|invoice|commit|build|revision"
CONTEXT = 48
ROUNDS, SMOOTH = 30, 1.0


def _match_rows(text: Column, kind: str) -> Column:
    """array<struct<pos, len, match, head, tail>>: the text cut before each match of a kind; the first has none."""
    marked = F.regexp_replace(F.translate(text, OPEN + CLOSE, OTHER * 2), PATTERNS[kind], f"{OPEN}$0{CLOSE}")
    row = lambda p, i: F.struct(
        i.alias("pos"),
        (F.length(p) - F.when(i > 0, 1).otherwise(0)).alias("len"),
        F.when(i > 0, F.substring_index(p, CLOSE, 1)).alias("match"),
        F.when(i > 0, F.left(F.substring_index(p, CLOSE, -1), F.lit(1))).alias("head"),
        F.right(F.substring_index(p, CLOSE, -1), F.lit(CONTEXT)).alias("tail"),
    )
    cut = F.transform(F.split(marked, OPEN), row)
    return F.when(text.rlike(NEEDS[kind]), F.when(F.size(cut) > 1, cut))


def _luhn(digits: Column) -> Column:
    """Whether a string of at most 19 digits passes the Luhn check."""
    back = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        x = F.substring(back, i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, x).otherwise(x * 2 - F.when(x > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _strict() -> Column:
    """The regex labeler: does a candidate pass the checks of its kind."""
    digits, kind, match = F.regexp_replace("match", "[^0-9]", ""), F.col("kind"), F.col("match")
    n = F.length(digits)
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", match.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"))
        .when(kind == "card", F.when(n.between(16, 19), _luhn(digits)).otherwise(False))
        .when(kind == "phone", n.between(8, 15))
        .when(kind == "tel", match.rlike(r"^(?:\([0-9]{3}\)|[0-9]{3})"))
        .when(kind == "iban", F.length(F.replace(match, F.lit(" "), F.lit(""))).between(15, 34) & (n >= 10))
        .otherwise(True)
    )


def candidates(docs: DataFrame, key: str, text_col: str) -> DataFrame:
    """Rows (key, kind, start, end, base, votes and looks) of every candidate span of every document.

    `key` names one row; a document's matches of one kind are put in places by a running sum, so a document may have
    any number of them.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lists = F.array(*(F.struct(F.lit(k).alias("kind"), _match_rows(text, k).alias("rows")) for k in KINDS))
    rows = docs.select(F.col(key).alias("key"), F.explode(lists).alias("x")).filter(F.col("x.rows").isNotNull())
    rows = rows.select("key", F.col("x.kind").alias("kind"), F.explode("x.rows").alias("r")).select("key", "kind", "r.*").repartition("key")
    order = Window.partitionBy("key", "kind").orderBy("pos")
    placed = rows.select(
        "*",
        F.sum("len").over(order.rowsBetween(Window.unboundedPreceding, -1)).cast("long").alias("start"),
        F.lag("tail").over(order).alias("before"),
    ).filter(F.col("pos") > 0)
    by_kind = lambda table, column, flags="": F.coalesce(*(F.when(F.col("kind") == k, column.rlike(flags + p)) for k, p in table.items()))
    strict, size = _strict(), F.length("match")
    share = F.length(F.regexp_replace("match", "[^0-9]", "")) * 4 / size
    alone = F.coalesce(F.right("before", F.lit(1)), F.lit("")).rlike("[A-Za-z0-9]") | F.coalesce(F.col("head"), F.lit("")).rlike("[A-Za-z0-9]")
    return placed.select(
        "key", "kind", "start", (F.col("start") + size).alias("end"),
        (F.col("kind").isin(BASE) & strict).alias("base"),
        F.when(strict, 1).otherwise(-1).alias("v_regex"),
        F.when(by_kind(GAZETTEER, F.col("match")), 1).otherwise(-1).alias("v_gazetteer"),
        F.when(by_kind(CUES, F.col("before"), "(?i)"), 1).when(F.col("before").rlike("(?i)" + AGAINST), -1).otherwise(0).alias("v_context"),
        F.when(alone, -1).otherwise(1).alias("v_border"),
        F.least(F.lit(5), F.floor(size / 6)).cast("int").alias("size"),
        F.floor(share).cast("int").alias("share"),
    )


VOTES = ["v_regex", "v_gazetteer", "v_context", "v_border"]
LOOKS = ["kind", *VOTES, "size", "share"]


def reliabilities(counts: dict[tuple, float]) -> tuple[list[dict], dict[tuple, float]]:
    """Expectation-maximisation over counts of (kind, votes...): each labeler's P(vote | real or not), and posteriors.

    The prior is by kind; it starts from the majority of the votes.
    """
    post = {k: 1 / (1 + math.exp(-1.5 * sum(k[1:]))) for k in counts}
    table: list[dict] = []
    for _ in range(ROUNDS):
        table, prior = [], {}
        for j in range(len(VOTES)):
            own = {(v, y): SMOOTH * (3 if v == (1 if y else -1) else 1) for v in (-1, 0, 1) for y in (0, 1)}
            for k, n in counts.items():
                own[k[1 + j], 1] += n * post[k]
                own[k[1 + j], 0] += n * (1 - post[k])
            total = [sum(own[v, y] for v in (-1, 0, 1)) for y in (0, 1)]
            table.append({vy: x / total[vy[1]] for vy, x in own.items()})
        for kind in {k[0] for k in counts}:
            own = [(n, post[k]) for k, n in counts.items() if k[0] == kind]
            prior[kind] = (sum(n * p for n, p in own) + SMOOTH) / (sum(n for n, _ in own) + 2 * SMOOTH)
        for k in counts:
            odds = math.log(prior[k[0]] / (1 - prior[k[0]])) + sum(math.log(table[j][v, 1] / table[j][v, 0]) for j, v in enumerate(k[1:]))
            post[k] = 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))
    return table, post


def classifier(found: DataFrame) -> DataFrame:
    """(looks..., p): the final classifier's probability for each combination of looks that occurs.

    The combinations are few by their making (kinds x votes x buckets), however many candidates there are.
    """
    rows = [(tuple(r[c] for c in LOOKS), r["n"]) for r in found.groupBy(*LOOKS).agg(F.count("*").alias("n")).collect()]
    counts: dict[tuple, float] = {}
    for looks, n in rows:
        counts[looks[: 1 + len(VOTES)]] = counts.get(looks[: 1 + len(VOTES)], 0) + n
    _, post = reliabilities(counts)
    sums = [{} for _ in LOOKS]
    total = [SMOOTH, SMOOTH]
    for looks, n in rows:
        p = post[looks[: 1 + len(VOTES)]]
        for y, w in ((1, n * p), (0, n * (1 - p))):
            total[y] += w
            for j, v in enumerate(looks):
                sums[j][v, y] = sums[j].get((v, y), SMOOTH) + w
    out = []
    for looks, _ in rows:
        odds = math.log(total[1] / total[0]) + sum(math.log(sums[j][v, 1] / total[1]) - math.log(sums[j][v, 0] / total[0]) for j, v in enumerate(looks))
        out.append((*looks, 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))))
    kinds = {f.name: f.dataType.simpleString() for f in found.schema.fields}
    return found.sparkSession.createDataFrame(out, ", ".join(f"`{c}` {kinds[c]}" for c in LOOKS) + ", p double")


def _free(names: list[str], wanted: str) -> str:
    """A column name that no column has."""
    while wanted.lower() in (n.lower() for n in names):
        wanted += "_"
    return wanted


def _judged(docs: DataFrame, text_col: str, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The documents that hold no candidate; the others with a number; and the spans that stay: (key, k, start, end, kind, base).

    Added spans that overlap base ones go: that is told from the furthest end of the base spans that begin at or before
    the span and from the next base span after it, so a document's work grows with its spans, not with their pairs.
    """
    maybe = F.coalesce(F.col(text_col).rlike(ANY), F.lit(False))
    # Documents that hold no candidate go past the shuffles. The others keep a number by their place in the scan.
    numbered = stored(docs.filter(maybe).withColumn(key, F.monotonically_increasing_id()), "pii-documents")
    found = stored(candidates(numbered, key, text_col), "pii-candidates")
    judged = found.join(F.broadcast(classifier(found)), LOOKS, "left").filter(F.col("base") | (~F.col("kind").isin(BASE) & (F.col("p") >= 0.5)))
    up = Window.partitionBy("key").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("key").orderBy(F.col("start").desc()).rangeBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max(F.when(F.col("base"), F.col("end"))).over(up) > F.col("start"), F.lit(False))
    follows = F.coalesce(F.min(F.when(F.col("base"), F.col("start"))).over(down) < F.col("end"), F.lit(False))
    place = F.coalesce(*(F.when(F.col("kind") == k, F.lit(i)) for i, k in enumerate(KINDS)))
    rows = judged.select("key", place.alias("k"), "start", "end", "kind", "base", (reached | follows).alias("over"))
    return docs.filter(~maybe), numbered, rows.filter(F.col("base") | ~F.col("over")).drop("over")


def find(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The frame's columns plus base_spans and spans: arrays of struct<k, start, end, kind> by k, then start.

    k is the place of the kind in KINDS; start and end are code points, end exclusive. Null and empty texts have no
    spans; rows stay one to one, repeated ones included; columns named base_spans or spans are replaced. Added spans
    never overlap base spans. Texts are searched whole, and a document may have any number of spans.
    """
    kept = docs.drop("base_spans", "spans")
    key = _free([*kept.columns, "key"], "_key")
    empty = F.array().cast("array<struct<k:int,start:bigint,end:bigint,kind:string>>")
    none, numbered, rows = _judged(kept, text_col, key)
    span = F.struct("k", "start", "end", "kind")
    by_doc = rows.groupBy("key").agg(F.array_sort(F.collect_list(F.when(F.col("base"), span))).alias("base_spans"), F.array_sort(F.collect_list(span)).alias("spans"))
    hit = numbered.join(by_doc.withColumnRenamed("key", key), key, "left").select(*kept.columns, *(F.coalesce(F.col(c), empty).alias(c) for c in ("base_spans", "spans")))
    return none.select("*", empty.alias("base_spans"), empty.alias("spans")).unionByName(hit)


def joined(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_of(kind: str) -> Column:
    """How many base spans of a kind there are."""
    return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with every span replaced by its kind in brackets, the other columns as they are.

    Spans that overlap are replaced as one, from the least start to the greatest end; the longest one names the kind.
    Null and empty texts stay as they are; rows stay one to one, whatever their columns are called.
    """
    key = _free([*docs.columns, "key"], "_key")
    pieces = _free([*docs.columns, key], "_pieces")
    none, numbered, rows = _judged(docs, text_col, key)
    order = Window.partitionBy("key").orderBy("start", "end", "k")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    first = F.when(F.col("start") < reached, 0).otherwise(1)  # null: nothing stands before
    islands = rows.withColumn("first", first).withColumn("island", F.sum("first").over(order))
    longest = F.max(F.struct((F.col("end") - F.col("start")).alias("size"), (-F.col("start")).alias("early"), (-F.col("k")).alias("place"), "kind"))["kind"]
    whole = islands.groupBy("key", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), longest.alias("kind"))
    by_doc = whole.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias(pieces)).withColumnRenamed("key", key)
    text, parts = F.col(text_col), F.col(pieces)

    def piece(span: Column, i: Column) -> Column:
        """The text between the span before and this one, and this one's kind."""
        at = F.coalesce(F.get(parts, i - 1)["end"], F.lit(0).cast("long"))
        return F.concat(F.substring(text, (at + 1).cast("int"), (span["start"] - at).cast("int")), F.lit("["), F.upper(span["kind"]), F.lit("]"))

    rest = F.substring(text, (F.get(parts, F.size(parts) - 1)["end"] + 1).cast("int"), F.length(text))
    new = F.when(parts.isNull(), text).otherwise(F.concat(F.array_join(F.transform(parts, piece), ""), rest))
    hit = numbered.join(by_doc, key, "left").withColumn(text_col, new).select(docs.columns)
    return none.unionByName(hit)
