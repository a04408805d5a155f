"""HTML extraction with a site style tree.

The DOMs of a host are merged into one style tree: nodes with the same path of tags and class or id names are one style
node. Each style node gets an importance from all pages of its host. Content: a text (all that stands in a node, on one
page) that occurs on c of the m pages with the node has the entropy log c / log m; the node's content importance is one
less the mean entropy of its texts. Equal pages of a host are merged before, so c and m count different pages.
Presentation: the entropy of the child sequences that its pages show. Both are mixed as in the published scheme, by
0.9 ^ (number of child styles). Branches of low importance are removed from every page of the host.

Every rendered node takes part in these statistics, whatever its name. Tags and names that usually mark menus, headers,
footers, sidebars, notices, adverts, forms or comments are a prior: a node's importance is multiplied by `WEAK` or `STRONG`
before it meets the limit. A weak name goes unless its host shows that its texts differ from page to page; a strong one
goes even then, as comments and adverts are new on every page. What a node's host cannot tell, because it has too few pages,
counts as 0.5. The prior does not touch nodes that hold an article or main, nor, on pages without these, nodes that
hold half of the page's text. `article`, `main` and what is in them have a lower limit, so mirrored articles stay.

The statistics are counts by (host, node, text), aggregated before they are shuffled, so a host with a third of all
pages is one row a node and text from each task. The importances of a host reach its pages by a broadcast if they fit
a measured bound and otherwise by a join on host and salt.

Defined results: null or empty html gives the empty text; pages without a host, and those of small hosts, lose what the
prior alone removes; cut-off tags at the end are dropped; repeated pages are extracted each (and count as one page in the
tree); an empty table gives no rows. Inline elements with a class or id are nodes too, but don't end a block. Output
columns replace columns of equal name; other columns may have any name.
"""

from __future__ import annotations

import html as entities
import re

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleloom.llm.common import BROADCAST_BYTES, append_columns, blobs, cut, sliced, small_batches

#: Least pages of a host for its tree to judge; importance below which a branch goes, outside and inside an article.
MIN_PAGES, THRESHOLD, THRESHOLD_ARTICLE = 5, 0.3, 0.1
#: What names do to a node's importance (inside an article to the share of the lower limit), and what an unknown one counts.
WEAK, STRONG, UNKNOWN = 0.5, 0.25, 0.5
SALTS = 64

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)",
    re.S,
)
NAME = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "title", "textarea", "noscript", "iframe", "template", "svg", "math", "object", "canvas", "audio", "video", "select", "button"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark",
    "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
#: A start tag of the key ends an open element of the value.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements that end what is open inside them but not themselves.
SCOPES = {"ul", "ol", "dl", "table", "div", "article", "section", "main", "body", "html", "blockquote", "td", "th", "nav", "aside", "footer", "header"}

#: Tags and names that mark what is seldom main text. A header inside an article or main is none of them.
STRONG_TAGS = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "fieldset", "legend", "marquee"}
STRONG_NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "adbox", "sponsor", "sponsored", "promo", "promotion", "nav", "navbar", "navigation", "menu", "breadcrumb",
    "breadcrumbs", "sidebar", "complementary", "contentinfo", "cookie", "cookies", "consent", "gdpr", "popup", "modal", "overlay", "dialog", "comment", "comments", "respond",
    "reply", "replies", "disqus", "share", "sharing", "social", "related", "recommended", "recommendations", "newsletter", "subscribe", "subscription", "signup", "login",
    "form", "widget", "widgets", "pagination", "pager", "outbrain", "taboola",
}
WEAK_NAMES = {"banner", "side", "aside", "footer", "foot", "header", "masthead", "topbar", "toolbar", "notice", "notices", "alert", "search", "copyright", "legal", "disclaimer", "skip", "tags"}


def parse(page: str):
    """(nodes, blocks): nodes are (parent, tag, names), parents before children; a block is a list of (node, text) runs."""
    nodes: list[tuple[int, str, str]] = [(-1, "", "")]
    stack, blocks, runs = [0], [], []
    opened: dict[str, int] = {}
    low = None

    def flush():
        if runs:
            if any(t.strip() for _, t in runs):
                blocks.append([(n, entities.unescape(t)) for n, t in runs])
            runs.clear()

    def say(text):
        if runs and runs[-1][0] == stack[-1]:
            runs[-1] = (stack[-1], runs[-1][1] + text)
        else:
            runs.append((stack[-1], text))

    def close(k):
        for i in stack[k:]:
            opened[nodes[i][1]] -= 1
        del stack[k:]

    at = 0
    for m in iter(lambda: TOKEN.search(page, at), None):
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        if m["cdata"]:
            say(m["cdata"])
        tag = m["tag"] or m["tag2"]
        if not tag:
            continue
        tag = tag.lower()
        inline = tag in INLINE
        if m["end"] or m["end2"]:
            if not inline:
                flush()
            if opened.get(tag):
                for k in range(len(stack) - 1, 0, -1):
                    if nodes[stack[k]][1] == tag:
                        close(k)
                        break
                    if nodes[stack[k]][1] in SCOPES and tag not in SCOPES:
                        break
            continue
        if tag == "br":
            say(" ")
            continue
        attrs = m["attrs"] if m["tag"] else m["attrs2"]
        names = " ".join(x.strip("\"'") for x in NAME.findall(attrs)).lower() if attrs else ""
        if inline and (not names or tag in VOID):
            continue
        if not inline:
            flush()
            if tag in VOID:
                continue
            if nodes[stack[-1]][1] == "p":
                close(len(stack) - 1)
            if tag in ENDS and any(map(opened.get, ENDS[tag])):
                for k in range(len(stack) - 1, 0, -1):
                    if nodes[stack[k]][1] in ENDS[tag]:
                        close(k)
                        break
                    if nodes[stack[k]][1] in SCOPES:
                        break
        if attrs and attrs.rstrip().endswith("/") and tag not in RAW:
            continue
        if tag in RAW:
            if low is None:
                low = page.lower()
            end = low.find(f"</{tag}", at)
            shut = page.find(">", end) if end >= 0 else -1
            at = shut + 1 if shut >= 0 else len(page)
            continue
        nodes.append((stack[-1], tag, names))
        stack.append(len(nodes) - 1)
        opened[tag] = opened.get(tag, 0) + 1
    if at < len(page):
        say(page[at:])
    flush()
    return nodes, blocks


def inside_articles(nodes) -> list[bool]:
    """Whether a node is an article or main, or in one."""
    out: list[bool] = []
    for parent, tag, _ in nodes:
        out.append(tag in ("article", "main") or parent >= 0 and out[parent])
    return out


def priors(nodes, blocks) -> list[float]:
    """What names do to each node's importance."""
    within = inside_articles(nodes)
    holds = [tag in ("article", "main") for _, tag, _ in nodes]
    size = [0] * len(nodes)
    for block in blocks:
        for n, t in block:
            size[n] += len(t)
    for i in range(len(nodes) - 1, 0, -1):
        size[nodes[i][0]] += size[i]
        if holds[i]:
            holds[nodes[i][0]] = True
    out = []
    for i, (parent, tag, names) in enumerate(nodes):
        words = set(NAME_EDGES.split(names)) if names else ()
        p = 1.0
        if tag in STRONG_TAGS and not (tag == "header" and within[i]) or words and not STRONG_NAMES.isdisjoint(words):
            p = STRONG
        elif words and not WEAK_NAMES.isdisjoint(words):
            p = WEAK
        if p < 1 and (holds[i] or not holds[0] and 2 * size[i] >= size[0] and tag not in STRONG_TAGS):
            p = 1.0
        out.append(p)
    return out


NAME_EDGES = re.compile(r"[^a-z0-9]+")


def style_nodes(nodes) -> list[int]:
    """The style node of each DOM node: a hash of its path of tags and names. The top bit tells nodes inside an article or main."""
    out: list[int] = []
    for parent, tag, names in nodes:
        up = out[parent] if parent >= 0 else 0
        h = xxhash.xxh64_intdigest(f"{up} {tag} {names}") >> 1
        out.append(h | (1 << 63 if up >> 63 or tag in ("article", "main") else 0))
    return out


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _features(page: str) -> tuple[set, set, set]:
    """((node, text hash), (node, child sequence hash)) pairs and style nodes of a page. A node's text is all that stands in it."""
    nodes, blocks = parse(page)
    style = [signed(x) for x in style_nodes(nodes)]
    text = [0] * len(nodes)
    for block in blocks:
        for n, t in block:
            if words := " ".join(t.split()):
                text[n] = xxhash.xxh64_intdigest(words, text[n])
    children: dict[int, list[str]] = {}
    for i in range(len(nodes) - 1, 0, -1):
        parent, tag, names = nodes[i]
        if text[i]:
            text[parent] = xxhash.xxh64_intdigest(b"%d" % text[i], text[parent])
        if parent > 0 and tag not in INLINE:
            children.setdefault(parent, []).append(f"{tag} {names}")
    texts = {(style[i], signed(text[i])) for i in range(1, len(nodes)) if text[i]}
    shows = {(style[i], signed(xxhash.xxh64_intdigest("|".join(_runs(c))))) for i, c in children.items()}
    return texts, shows, set(style[1:])


def _runs(items: list[str]):
    """Items without immediate repetitions, so that the number of paragraphs is no style."""
    return [x for i, x in enumerate(items) if i == 0 or items[i - 1] != x]


def style_tree(pages: DataFrame, min_pages: int = MIN_PAGES, threshold: float = THRESHOLD, inside: float = THRESHOLD_ARTICLE) -> DataFrame:
    """(host, low, mid): a host's style nodes whose importance is below the limit, and those that a weak name would bring
    below it. pages: host, html."""

    def post(batches):
        import pyarrow as pa

        for batch in sliced(batches):
            rows = []
            for host, raw in zip(batch.column("host").to_pylist(), blobs(batch, "html")):
                texts, shows, own = _features(raw.decode("utf-8", "replace"))
                rows += [(host, n, 0, h) for n, h in texts]
                rows += [(host, n, 1, h) for n, h in shows]
                rows += [(host, n, 2, 0) for n in own]
            cols = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int32(), pa.int64()))], names=["host", "node", "kind", "feature"])

    once = small_batches(pages).where("host <> '' and html is not null").select("host", "html").distinct()
    counts = once.mapInArrow(post, "host string, node long, kind int, feature long").groupBy("host", "node", "kind", "feature").agg(F.count("*").alias("c"))
    text, look, c = F.col("kind") == 0, F.col("kind") == 1, F.col("c")
    node = counts.groupBy("host", "node").agg(
        F.max(F.when(text, c)).alias("most"), F.count(F.when(text, c)).alias("texts"), F.sum(F.when(text, F.log2("c"))).alias("logc"),
        F.sum(F.when(look, c)).alias("shown"), F.count(F.when(look, c)).alias("styles"), F.sum(F.when(look, c * F.log2("c"))).alias("clogc"),
        F.max(F.when(F.col("kind") == 2, c)).alias("with_node"),
    ).where("texts > 0")
    sizes = once.groupBy("host").agg(F.count("*").alias("pages"))
    node = node.join(sizes, "host").where(F.col("pages") >= min_pages)
    m = F.greatest("with_node", F.lit(2))
    content = 1 - F.col("logc") / F.col("texts") / F.log2(m)
    look = F.when(F.col("shown") > 1, (F.log2("shown") - F.col("clogc") / F.col("shown")) / F.log2("shown")).otherwise(F.lit(1.0))
    mixed = F.when(F.col("shown").isNull(), content).otherwise((1 - F.pow(F.lit(0.9), "styles")) * look + F.pow(F.lit(0.9), "styles") * content)
    limit = F.when(F.col("node") < 0, F.lit(inside)).otherwise(F.lit(threshold))
    known = node.select("host", "node", F.greatest(mixed, content).alias("importance"), limit.alias("limit"), "with_node").where(F.col("with_node") >= min_pages)
    low, mid = F.col("importance") < F.col("limit"), F.col("importance") * WEAK < F.col("limit")
    return known.groupBy("host").agg(
        F.collect_list(F.when(low, F.col("node"))).alias("low"), F.collect_list(F.when(mid & ~low, F.col("node"))).alias("mid"),
        F.collect_list(F.when(~mid, F.col("node"))).alias("high"),
    )


def main_text(page: str, low=frozenset(), mid=frozenset(), high=frozenset(), names: bool = True) -> str:
    """The blocks of a page that are in no branch of low importance, one a line. Of its style nodes those in low go, those
    in mid with a weak or strong name, those in high with a strong one, and unknown ones with either."""
    nodes, blocks = parse(page)
    style = [signed(x) for x in style_nodes(nodes)] if low or mid or high else None
    prior = priors(nodes, blocks) if names else None
    bad = [False] * len(nodes)
    for i, (parent, _, _) in enumerate(nodes):
        if i == 0:
            continue
        node = style[i] if style else None
        bad[i] = bad[parent] or node in low or names and (prior[i] == STRONG or prior[i] == WEAK and node not in high)
    out = []
    for block in blocks:
        if text := " ".join("".join([t for n, t in block if not bad[n]]).split()):
            out.append(text)
    return "\n".join(out)


def extract_text(pages: DataFrame, host, html: str = "html", names: bool = True, tree: bool = True, **limits) -> DataFrame:
    """Append text (the main text) and n_chars (its code points). host: a column expression. names, tree: whether names
    and the style tree have a say; without either all rendered text stays."""
    kept = [c for c in pages.columns if c not in ("text", "n_chars")]
    plain = pages.select(*[F.col(c).alias(f"_d_{c}") for c in kept], F.col(html).alias("_html"), host.alias("_host"))
    if not tree:
        empty = F.array().cast("array<long>")
        joined = plain.withColumns({"_low": empty, "_mid": empty, "_high": empty})
    else:
        known = cut(style_tree(plain.select(F.col("_host").alias("host"), F.col("_html").alias("html")), **limits))
        known = known.select(F.col("host").alias("_site"), F.col("low").alias("_low"), F.col("mid").alias("_mid"), F.col("high").alias("_high"))
        size = known.agg(F.sum((F.size("_low") + F.size("_mid") + F.size("_high")) * 8 + F.length("_site") + 48)).first()[0] or 0
        if size <= BROADCAST_BYTES:
            joined = plain.join(F.broadcast(known), F.col("_host") == F.col("_site"), "left")
        else:
            salted = known.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            dealt = plain.withColumn("_s", F.pmod(F.xxhash64("_html"), F.lit(SALTS)).cast("int"))
            joined = dealt.join(salted, (F.col("_host") == F.col("_site")) & (F.col("_s") == F.col("_salt")), "left")

    def make():
        sets: dict = {}

        def of(host, *lists):
            if host not in sets:
                if len(sets) > 1000:
                    sets.clear()
                sets[host] = [frozenset(x.as_py() or ()) for x in lists]
            return sets[host]

        def work(batch):
            hosts = batch.column("_host").to_pylist()
            columns = [batch.column(c) for c in ("_low", "_mid", "_high")]
            texts = [main_text(raw.decode("utf-8", "replace"), *of(hosts[i], *(c[i] for c in columns)), names=names) if raw else "" for i, raw in enumerate(blobs(batch, "_html"))]
            return {"text": texts, "n_chars": [len(t) for t in texts]}

        return work

    done = append_columns(joined, "text string, n_chars bigint", make)
    return done.select(*[F.col(f"_d_{c}").alias(c) for c in kept], "text", "n_chars")
