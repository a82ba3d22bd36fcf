"""HTML as a tree of block elements: what the extraction model looks at, and the text blocks that it keeps or drops."""

from __future__ import annotations

import html
import re

# Kinds of elements by the HTML standard.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
HIDDEN = set("head script style noscript template svg math iframe object select option button textarea input datalist canvas audio video".split())
FRAMES = set("nav aside footer".split())
RAW = set("script style textarea title xmp noembed noframes iframe".split())
CLOSES_P = set("address article aside blockquote center details dialog dd dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table ul".split())
#: A start tag of a key ends an open element of its values, unless an element of the list's scope stands between.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "body": ("head",)}
SCOPE = set("ul ol dl table select html body div section article".split())
# Words of classes, ids and roles that tell what an element is for.
AGAINST = "ad ads advert advertisement adverts aside banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer disqus footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice overlay pager pagination popup promo promoted recommended related replies reply respond share sharing sidebar signup social sponsor sponsored subscribe tags teaser toolbar topbar widget".split()
FOR = "article articlebody body content entry main post prose story text".split()

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']++|\"[^\"<]*\"|'[^'<]*')*+|[^>]*)>|<[!?][^>]*>", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|data-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z]+")
_CUES = {**{w: "against" for w in AGAINST}, **{w: "for" for w in FOR}}


class Tree:
    """Elements in page order: each one's parent comes before it. Inline elements belong to the block around them."""

    def __init__(self, page: str):
        self.tags, self.parents, self.cues, self.labels, self.hidden = ["#page"], [-1], ["none"], [None], [False]
        self.chars, self.linked, self.stops, self.framed, self.within = [0], [0], [0], [False], [False]
        #: Pieces of text: (element, text, number of the block that it stands in).
        self.pieces: list[tuple[int, str, int]] = []
        self._read(page)
        self._drop_forms()
        for i in range(len(self.tags) - 1, 0, -1):  # sums over subtrees
            p = self.parents[i]
            self.chars[p] += self.chars[i]
            self.linked[p] += self.linked[i]
            self.stops[p] += self.stops[i]
        self._forget_wrappers()

    def _below(self, i: int) -> range:
        """The elements within one, itself first: they follow each other."""
        end = i + 1
        while end < len(self.tags) and self.parents[end] >= i:
            end += 1
        return range(i, end)

    def _drop_forms(self) -> None:
        """Forms are hidden, but for one around the whole page: it holds an article or main element, or more than half of
        the page's text and three paragraphs."""
        forms = [i for i, t in enumerate(self.tags) if t == "form" and not self.hidden[i]]
        if not forms:
            return
        total, gone = sum(self.chars), False
        for i in forms:
            below = self._below(i)
            tags = [self.tags[j] for j in below]
            if "article" in tags or "main" in tags or 2 * sum(self.chars[j] for j in below) > total and tags.count("p") >= 3:
                continue
            gone = True
            for j in below:
                self.hidden[j] = True
                self.chars[j] = self.linked[j] = self.stops[j] = 0
        if gone:
            self.pieces = [p for p in self.pieces if not self.hidden[p[0]]]

    def _forget_wrappers(self) -> None:
        """The names of an element around the page's first heading (or a main element) and more than half of its text tell
        nothing: they speak of the page's layout."""
        heading = next((i for h in ("h1", "h2") for i, t in enumerate(self.tags) if t == h and not self.hidden[i]), None)
        inside = {i for i, t in enumerate(self.tags) if t == "main"} | ({heading} if heading is not None else set())
        around: set[int] = set()
        for i in inside:
            while (i := self.parents[i]) > 0:
                around.add(i)
        wide = [i for i in around if self.cues[i] == "against" and 2 * self.chars[i] > self.chars[0] and self.tags[i] not in FRAMES]
        for i in wide:
            self.cues[i] = "none"
        if wide:
            for i in range(1, len(self.tags)):
                tag = self.tags[i]
                own = tag in FRAMES or tag == "header" and not self.within[self.parents[i]] or self.cues[i] == "against" and tag not in ("html", "body")
                self.framed[i] = self.framed[self.parents[i]] or own

    def _open(self, tag: str, attributes: str, parent: int) -> int:
        cue, label = "none", None
        for name, *values in _ATTRIBUTE.findall(attributes) if attributes else ():
            value = "".join(values).lower()
            if name.lower() == "data-label":
                label = {"0": 0, "1": 1}.get(value, label)  # pages use the attribute for other things too
                continue
            for w in _WORD.findall(value):
                got = _CUES.get(w)
                if got == "against" or got and cue == "none":
                    cue = got
        self.tags.append(tag)
        self.parents.append(parent)
        self.cues.append(cue)
        self.labels.append(label)
        self.hidden.append(tag in HIDDEN or self.hidden[parent])
        # In something that names itself as being beside the text; a name of the whole page tells nothing.
        own = tag in FRAMES or tag == "header" and not self.within[parent] or cue == "against" and tag not in ("html", "body")
        self.framed.append(self.framed[parent] or own)
        self.within.append(self.within[parent] or tag in ("article", "main"))
        for sums in (self.chars, self.linked, self.stops):
            sums.append(0)
        return len(self.tags) - 1

    def _read(self, page: str) -> None:
        stack: list[tuple[str, int]] = [("#page", 0)]  # names with the block elements they stand in
        open_: dict[str, int] = {}
        at, block, end = 0, 0, len(page)

        def text(raw: str) -> None:
            if "&" in raw:
                raw = html.unescape(raw)
            node = stack[-1][1]
            if raw and not self.hidden[node]:
                self.pieces.append((node, raw, block))
                n = len(raw) - raw.count(" ")
                self.chars[node] += n
                self.linked[node] += n if open_.get("a") else 0
                self.stops[node] += sum(map(raw.count, ".!?,;:"))

        def leave(names: tuple[str, ...], scope: set[str] = frozenset()) -> None:
            if not any(open_.get(n) for n in names):
                return
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in names:
                    for name, _ in stack[k:]:
                        open_[name] -= 1
                    del stack[k:]
                    return
                if stack[k][0] in scope:
                    return

        while at < end:
            m = _TAG.search(page, at)
            if m is None:
                text(page[at:])
                break
            if m.start() > at:
                text(page[at : m.start()])
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            inline = tag in INLINE
            block += not inline
            if m[1]:
                leave((tag,))
                continue
            if tag == "br":
                text(" ")
            if tag in CLOSES_P:
                leave(("p",))
            if tag in ENDS:
                leave(ENDS[tag], SCOPE - set(ENDS[tag]))
            node = stack[-1][1] if inline else self._open(tag, m[3], stack[-1][1])
            if tag in VOID or m[3].endswith("/") and tag in ("path", "circle", "rect", "use"):
                continue
            if tag in RAW:
                close = re.compile(rf"</{tag}\b", re.I).search(page, at)
                at = close.start() if close else end
            stack.append((tag, node))
            open_[tag] = open_.get(tag, 0) + 1

    def text(self, keep: list[bool]) -> str:
        """The kept pieces: white space within a block is one space, blocks are joined in page order by line ends."""
        blocks: list[list[str]] = []
        last = None
        for node, raw, block in self.pieces:
            if keep[node]:
                if block != last:
                    blocks.append([])
                    last = block
                blocks[-1].append(raw)
        return "\n".join(t for t in (" ".join("".join(b).split()) for b in blocks) if t)
