"""Main-text extraction by consensus host paths (operator 4).

1. Every page's containers (article, main, section, div, td, body) are scored by
   the text of their blocks less its links, blocks further down counting less.
2. The page votes for the generalised path of its best containers: tags with their
   class words, numbers in them replaced, from body down.  Spark sums the votes per
   host; a host with a third of all pages is summed map-side first.
3. Each page is read again with its host's winning path.  A page without such a
   container falls back on its own best one.
4. The article may go beyond that container (a title or a second part beside it):
   the text is that of the outermost article around it, or of a main element or a
   post's container around that if it holds no other article.  What this adds must
   not be mostly links.

Text inside menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles and reader comments is left out, by tag, role, and class or id words.
Headings in a header inside the main container stay (an article's title).

Null html is empty and gives an empty text.  Null or odd urls share the empty host.
Pages without any container text give an empty text.  Repeated rows are kept, an
empty table gives no rows, extra columns are ignored.  Broken markup is read with
the usual repairs: p, li and table cells close themselves, stray end tags are
skipped, an unclosed script or comment runs to the end.
"""

from __future__ import annotations

import html as html_entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, stored
from .registry import register

#: Containers that a page may vote for, with the best one's weight 1.
VOTES = 3
#: Most hosts whose winning paths are broadcast (about 100 bytes each); beyond, they are joined by shuffle.
BROADCAST_HOSTS = 100_000
PATH_DEPTH = 12

# Fixed values of HTML: element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template svg math object".split())
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption
    figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre
    search section select summary table tbody td tfoot th thead tr ul""".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINER = frozenset("article body div main section td".split())
#: Tag -> (tags that it closes, tags that stop the search for them).
CLOSES = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
          "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
          "option": (("option",), ("select",))}
#: Elements that a <p> end or start does not reach beyond.
SCOPE = frozenset("article aside body button div dl footer form header li main nav ol section table td th ul blockquote".split())

# Words of class and id names, and roles, that mark text which is not the article.
JUNK_TAG = frozenset("nav aside footer form button select head dialog menu fieldset".split()) | RAW
JUNK_WORDS = frozenset("""ad ads advert adverts advertisement advertising adsense banner banners sponsor sponsored sponsors promo
    promos promotion comment comments commentlist respond disqus reply replies sidebar sidebars aside rail nav navbar navigation menu
    menus breadcrumb breadcrumbs footer foot masthead topbar toolbar cookie cookies consent gdpr notice notices alert alerts
    warning popup modal overlay newsletter subscribe subscription signup login register share sharing social related recommended
    recommendations widget widgets pagination pager paging""".split())
HEADER_WORDS = frozenset("header head heading pageheader siteheader".split())
#: Words of class and id names of a container that holds one article.
ARTICLE_WORDS = frozenset("article entry post story".split())
GOOD_WORDS = frozenset("article body content entry main post story text".split())
JUNK_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog form menu menubar".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*+)>""", re.S)
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'])(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|(?=[\s/]|$))""", re.I)
_NAME_WORD = re.compile(r"[A-Za-z][a-z]*|[A-Z]+|\d+")
_DIGITS = re.compile(r"\d+")
_RAW_END = {tag: re.compile(f"</{tag}(?=[\\s/>])[^>]*>", re.I) for tag in RAW}


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(text)} if text else {}


class Page:
    """One parse: containers (parent, path, tag, bonus) and blocks (container, text, link characters, heading)."""

    def __init__(self, source: str):
        self.parents, self.paths, self.weights, self.kinds = [-1], [""], [0.6], [""]  # container 0: the page itself
        self.blocks: list[tuple[int, str, int, bool]] = []
        # An open element: tag, container below it, text is left out, text counts as header only.
        self.open: list[tuple[str, int, bool, bool]] = [("", 0, False, False)]
        self.text: list[str] = []
        self.links = 0
        self.in_link = 0
        self._read(source)

    def _flush(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            self.text.clear()
            tag, container, junk, header = self.open[-1]
            heading = any(e[0] in HEADING for e in self.open[-4:])
            if text and not junk and not (header and not heading):
                self.blocks.append((container, text, min(self.links, len(text)), heading))
        self.links = 0

    def _add(self, raw: str) -> None:
        if raw and not self.open[-1][2]:
            text = html_entities.unescape(raw) if "&" in raw else raw
            self.text.append(text)
            if self.in_link:
                self.links += len(text.strip())

    def _pop_to(self, index: int) -> None:
        self._flush()
        self.in_link = max(0, self.in_link - sum(e[0] == "a" for e in self.open[index:]))
        del self.open[index:]

    def _close_before(self, tag: str) -> None:
        """End elements that the start of ``tag`` closes."""
        names, stops = CLOSES.get(tag, ((), ()))
        if names:
            for k in range(len(self.open) - 1, 0, -1):
                if self.open[k][0] in names:
                    return self._pop_to(k)
                if self.open[k][0] in stops:
                    break
        if tag in BLOCK:
            for k in range(len(self.open) - 1, 0, -1):
                if self.open[k][0] == "p":
                    return self._pop_to(k)
                if self.open[k][0] in SCOPE:
                    break

    def _start(self, tag: str, attributes: str) -> None:
        self._close_before(tag)
        _, container, junk, header = self.open[-1]
        if tag in BLOCK:
            self._flush()
            found = _attributes(attributes)
            names = f"{found.get('class', '')} {found.get('id', '')}"
            words = {w.lower() for w in _NAME_WORD.findall(names)}
            junk = (junk or tag in JUNK_TAG or bool(words & JUNK_WORDS and tag not in ("body", "html", "article", "main"))
                    or found.get("role", "").lower() in JUNK_ROLES or "hidden" in found
                    or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower())
            header = header or tag == "header" or bool(words & HEADER_WORDS and tag not in ("body", "html", "article", "main"))
            if tag in CONTAINER:
                classes = ".".join(sorted({_DIGITS.sub("#", c) for c in found.get("class", "").split()}))
                step = f"{tag}.{classes}" if classes else tag
                parent = self.paths[container]
                path = f"{parent}/{step}" if parent.count("/") < PATH_DEPTH else parent
                bonus = {"article": 1.5, "main": 1.3, "body": 0.6}.get(tag, 1.0) * (1.25 if words & GOOD_WORDS else 1.0)
                self.parents.append(container)
                self.paths.append(path)
                self.weights.append(bonus)
                one = tag != "body" and bool(words & ARTICLE_WORDS)
                self.kinds.append(tag if tag in ("article", "main") else "post" if one else "")
                container = len(self.paths) - 1
        elif tag == "br":
            self.text.append(" ")
        elif tag == "a":
            self.in_link += 1
        if tag not in VOID:
            self.open.append((tag, container, junk, header))
        elif tag == "hr":
            self._flush()

    def _end(self, tag: str) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] == tag:
                if tag in BLOCK:
                    self._pop_to(k)
                else:
                    self.in_link = max(0, self.in_link - (tag == "a"))
                    del self.open[k]
                return
            if tag not in BLOCK and self.open[k][0] in BLOCK:
                return  # an inline end tag does not close blocks
            if tag == "p" and self.open[k][0] in SCOPE:
                return

    def _read(self, source: str) -> None:
        at = 0
        while at < len(source):
            m = _TAG.search(source, at)
            if m is None:
                self._add(source[at:])
                break
            self._add(source[at:m.start()])
            at = m.end()
            if m[2] is None:
                if m[0].startswith("<![CDATA["):
                    self._add(m[0][9:-3])
                continue
            tag = m[2].lower()
            if m[1]:
                self._end(tag)
            elif tag in RAW:
                if not m[3].rstrip().endswith("/") or tag in ("script", "style", "textarea", "title"):
                    end = _RAW_END[tag].search(source, at)
                    at = end.end() if end else len(source)
            else:
                self._start(tag, m[3])
        self._flush()

    def scores(self) -> list[float]:
        """Score of every container: its blocks' text less links, halved and thinned out upwards."""
        out = [0.0] * len(self.paths)
        for container, text, links, _ in self.blocks:
            value = float(max(0, len(text) - 2 * links))
            depth = 1
            while container >= 0:
                out[container] += value / depth * self.weights[container]
                container, depth = self.parents[container], depth + 1
        return out

    def inside(self, container: int) -> set[int]:
        found = {container}
        for k in range(container + 1, len(self.parents)):
            if self.parents[k] in found:
                found.add(k)
        return found

    def text_below(self, container: int) -> str:
        """The blocks inside a container, in page order, one per line."""
        found = self.inside(container)
        return "\n".join(text for c, text, _, _ in self.blocks if c in found)

    def article_around(self, container: int) -> int:
        """The outermost container around this one that still is the same article."""
        around, k = [container], self.parents[container]
        while k > 0:
            around.append(k)
            k = self.parents[k]
        best = next((k for k in reversed(around) if self.kinds[k] == "article"), container)
        for k in around[around.index(best) + 1:]:
            if self.kinds[k] in ("main", "post"):
                own = self.inside(best)
                if any(self.kinds[j] in ("article", "post") and j != k and j not in own and j not in around for j in self.inside(k)):
                    break  # a list of articles
                best = k
        return best

    def article_text(self, container: int) -> str:
        """The container's blocks and those of its article around it that are not mostly links."""
        own, whole = self.inside(container), self.inside(self.article_around(container))
        return "\n".join(text for c, text, links, _ in self.blocks if c in own or (c in whole and 2 * links < len(text)))


def page_votes(source: str) -> list[tuple[str, float]]:
    """Paths of the best containers with their score relative to the best."""
    page = Page(source)
    best: dict[str, float] = {}
    for path, score in zip(page.paths, page.scores()):
        if score > best.get(path, 0.0):
            best[path] = score
    top = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:VOTES]
    return [(path, score / top[0][1]) for path, score in top]


def page_text(source: str, path: str | None) -> str:
    """Text of the page's best container on ``path``, or of its best container at all."""
    page = Page(source)
    scores = page.scores()
    on_path = [k for k, p in enumerate(page.paths) if p == path and scores[k] > 0]
    among = on_path or [k for k in range(len(scores)) if scores[k] > 0] or [0]
    return page.article_text(max(among, key=lambda k: (scores[k], -k)))


def host_of(url) -> F.Column:
    host = F.regexp_extract(F.lower(F.coalesce(url.cast("string"), F.lit(""))), r"^\s*[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.regexp_replace(host, r"\.$", "")


def host_paths(pages: DataFrame) -> DataFrame:
    """host, path: the container path with the most votes of each host (ties: the first by name)."""

    def votes(batches):
        for batch in batches:
            rows = [(host, path, weight) for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                    for path, weight in page_votes(source)]
            host, path, weight = map(list, zip(*rows)) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(path, pa.string()), pa.array(weight, pa.float64())],
                                             ["host", "path", "weight"])

    cast = pages.select(host_of(F.col("url")).alias("host"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    # Weights are summed as whole numbers, so the order of the sums cannot change a vote.
    ballots = (cast.mapInArrow(votes, "host string, path string, weight double")
               .groupBy("host", "path").agg(F.sum(F.round(F.col("weight") * 1000).cast("long")).alias("votes")))
    return ballots.groupBy("host").agg(F.min(F.struct((-F.col("votes")).alias("order"), "path")).alias("best")).select(
        "host", F.col("best.path").alias("path"))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages`` (page_id, url, html)."""
    winners = stored(host_paths(pages), "host-paths")
    few = winners.count() <= BROADCAST_HOSTS
    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    joined = rows.join(F.broadcast(winners) if few else winners, "host", "left").select("page_id", "url", "html", "path")
    kinds = dict(joined.dtypes)

    def extract(batches):
        for batch in batches:
            texts = [page_text(s, p) for s, p in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             ["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


@register("op4_html_extraction")
def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(read_table(spark, sf_dir, "pages"))
