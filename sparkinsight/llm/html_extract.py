"""HTML extraction: markup structure, and a suffix array over the pages of each host.

A page becomes blocks of text, each declared article, declared chrome (menus, footers,
adverts, forms, comments ...) or plain.  The token streams of everything outside the
declared articles are concatenated and suffix-sorted, per host and task; the distinct
pages of a host that hold a run are counted over all tasks, pages of equal text once.  Of pages that declare an article,
its blocks are the text; of doubtful ones (related-work, has-sidebar) the unrepeated runs.  Of other pages, tokens covered by a repeated run of their host
are boilerplate; the unique runs of the plain blocks are kept.
"""

from __future__ import annotations

import html as htmllib
import re
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .hashing import chunks, window_hashes

ARTICLE, CHROME, PLAIN, DOUBT = "article", "chrome", "plain", "doubtful"
# Elements by their role in a page.
DROP = frozenset("script style noscript template iframe svg canvas audio video map head title annotation annotation-xml".split())
CHROME_TAGS = frozenset("nav footer aside form button select textarea dialog menu search".split())
ARTICLE_TAGS = frozenset("article main".split())
BLOCK_TAGS = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption
    figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary
    table tbody tfoot thead tr ul caption option""".split())
SPACE_TAGS = frozenset("br td th wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# paragraphs and the like, which pages often leave open, do not hold a region
LEAF = frozenset("p li dt dd tr td th option h1 h2 h3 h4 h5 h6 a b i em strong span u s small font code".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog menu menubar alert".split())
CHROME_WORDS = frozenset("""ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie
    cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup share sharing social
    sidebar sidebars menu nav navbar navigation breadcrumb breadcrumbs footer comment comments disqus replies related
    recommended recommendations widget widgets toolbar pagination pager login masthead copyright skip""".split())
# what a name may hold beside a chrome word and still say what its element is: site-sidebar, ad-slot
FORMS = frozenset("""site global top bottom left right box bar block container wrapper wrap list link links item items area
    inner unit slot button buttons icon icons post posts article articles primary secondary sticky mobile desktop""".split())
PAGE_PARTS = frozenset("article main nav".split())
TEASER = 4  # articles shorter than the plain text by this factor are teasers
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

# a quote opens a value only behind an equals sign; one that never closes is a character as any other
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[/!?]?[a-zA-Z\[-](?:[^<>=]|=\s*(?:"[^"]*"|'[^']*')|=)*+>?""", re.S)
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
ATTR = re.compile(r"""([a-zA-Z_:][\w:.-]*)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
QUOTED = re.compile(r"""=\s*(?:"[^"]*"|'[^']*')""")
HIDDEN = re.compile(r"(?i)(?<![=\s])\s+hidden(?=[\s/>]|\Z)")


def _named(name: str, attrs: dict) -> str | None:
    """What class and id say: chrome if a whole name does, doubtful if only a part of one does."""
    kind = None
    if name in ("html", "body"):
        return kind
    for x in f"{attrs.get('class', '')} {'' if name in HEADINGS else attrs.get('id', '')}".split():
        parts = {w for w in re.split(r"[^a-z0-9]+", x) if w}
        if parts & CHROME_WORDS:
            if parts <= CHROME_WORDS | FORMS:
                return CHROME
            kind = DOUBT
    return kind


def _region(name: str, tag: str, inside_article: bool) -> str | None:
    """What an opening element declares its content to be, if anything."""
    if name in CHROME_TAGS or name == "header" and not inside_article:
        return CHROME
    attrs = {k.lower(): v.strip("\"'").lower() for k, v in ATTR.findall(tag)} if "=" in tag else {}
    if attrs.get("role") in CHROME_ROLES or attrs.get("hidden") is not None or attrs.get("aria-hidden") == "true":
        return CHROME
    if "hidden" in tag.lower() and name not in ("html", "body") and HIDDEN.search(QUOTED.sub("=", tag)):
        return CHROME
    if name in ARTICLE_TAGS or attrs.get("role") in ("main", "article") or attrs.get("itemprop") == "articlebody":
        # <article class="comment"> is a comment
        return CHROME if name == "article" and _named(name, attrs) == CHROME else ARTICLE
    return _named(name, attrs)


def _by_name(name: str, tag: str) -> bool:
    """Whether an element is chrome by nothing but its class or id."""
    return name not in ARTICLE_TAGS and _region(name, re.sub(r"(?i)\b(?:class|id)\s*=", "_=", tag), True) is None


def parse(page: str, holders: frozenset = frozenset(), teasers: bool = False) -> list[tuple[str, str]]:
    """(region, text) of the non-empty blocks of a page, in page order.

    Doubtful: inside an article, within an element that only a part of a name calls chrome.
    Where the only articles of a page stand in elements that are chrome by name, these
    (``holders``, by place in the page) are not chrome, nor is a form that holds parts of a
    page (its article or menu).  Where the articles of a page are ``teasers`` beside a
    longer text, they declare nothing.
    """
    out: list[tuple[str, str]] = []
    open_: list[tuple[str, str | None]] = []  # elements that can hold a region
    buf: list[str] = []
    chrome = article = doubt = 0
    forms: list[int | None] = []  # place of each open form
    named: list[int | None] = []  # place of each open element that is chrome by name alone
    held: set[int] = set()
    wraps: set[int] = set()  # forms around parts of the page
    strong = False  # a main text is declared by more than <article>
    pos, n, low = 0, len(page), None
    mute = None  # a leaf element declared chrome: its text is left out

    def flush():
        if buf:
            text = " ".join(htmllib.unescape("".join(buf)).split())
            buf.clear()
            if text:
                out.append((CHROME if chrome else PLAIN if not article else DOUBT if doubt else ARTICLE, text))

    while pos < n:
        m = TAG.search(page, pos)
        if not m:
            buf.append("" if mute else page[pos:])
            break
        if m.start() > pos and not mute:
            buf.append(page[pos:m.start()])
        pos, tag = m.end(), m.group()
        head = NAME.match(tag)
        if not head:
            continue
        name, closing = head[1].lower(), tag[1] == "/"
        if name in DROP and not closing:
            if tag.endswith("/>") or name == "head":
                continue
            low = page.lower() if low is None else low
            end = low.find(f"</{name}", pos)
            pos = n if end < 0 else end
            continue
        if name in SPACE_TAGS:
            buf.append(" ")
        elif name in BLOCK_TAGS:
            flush()
            mute = None
        if name in LEAF:
            # an advert or notice may be a paragraph: it holds to its end tag or the next block
            if closing and name == mute:
                mute = None
            elif not closing and not mute and ("=" in tag or "hidden" in tag.lower()) and _region(name, tag, article > 0) == CHROME:
                mute = name
            continue
        if name in VOID or name in DROP:
            continue
        if not closing:
            kind = _region(name, tag, article > 0)
            if kind == CHROME and m.start() in holders or kind == DOUBT and not article:
                kind = None
            if kind == ARTICLE and name == "article" and teasers:
                kind = None
            if kind and name not in BLOCK_TAGS:
                flush()
            strong |= kind == ARTICLE and name != "article"
            if name in PAGE_PARTS:
                wraps.update(x for x in forms if x is not None)
            if kind == ARTICLE and chrome:
                by = [x for (_, k), x in zip(open_, named) if k == CHROME]
                if None not in by:
                    held.update(by)
            open_.append((name, kind))
            named.append(m.start() if kind == CHROME and _by_name(name, tag) else None)
            forms.append(m.start() if kind == CHROME and name == "form" else None)
            doubt += kind == DOUBT
            chrome += kind == CHROME
            article += kind == ARTICLE
        else:
            at = next((i for i in range(len(open_) - 1, -1, -1) if open_[i][0] == name), None)
            if at is not None:
                if name not in BLOCK_TAGS and any(k for _, k in open_[at:]):
                    flush()
                for _, kind in open_[at:]:
                    chrome -= kind == CHROME
                    article -= kind == ARTICLE
                    doubt -= kind == DOUBT
                del open_[at:], named[at:], forms[at:]
    flush()
    if wraps - holders:
        return parse(page, holders | wraps, teasers)
    size = {r: sum(len(t) for k, t in out if k == r) for r in (ARTICLE, DOUBT, PLAIN)}
    own = size[ARTICLE] + size[DOUBT]
    if held - holders and not own:
        return parse(page, holders | held, teasers)
    if 0 < TEASER * own < size[PLAIN] and not strong and not teasers:
        return parse(page, holders, True)
    return out


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


# ---- suffix array ---------------------------------------------------------------------
def suffix_order(tokens: np.ndarray, depth: int):
    """(order, rank) of all suffixes by their first ``depth`` tokens (a power of two): prefix doubling."""
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64) + 1
    order, n, k = np.argsort(rank, kind="stable"), len(tokens), 1
    while k < depth:
        nxt = np.zeros(n, np.int64)
        nxt[:max(0, n - k)] = rank[k:]
        order = np.lexsort((nxt, rank))
        a, b = rank[order], nxt[order]
        new = np.cumsum(np.concatenate([[1], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        rank = np.empty(n, np.int64)
        rank[order] = new
        k *= 2
    return order, rank


class Streams:
    """Concatenated token streams of pages: words of their blocks, each block ended by one
    more mark per token of ``depth``, so that a suffix compares no further than its block."""

    END = 1

    def __init__(self, pages: list[list[str]], depth: int):
        tok, page, block, start = [], [], [], []
        word = {}
        for p, blocks in enumerate(pages):
            for b, text in enumerate(blocks):
                w = text.split()
                tok += [word.get(x) or word.setdefault(x, xxhash.xxh64_intdigest(x) | 2) for x in w]
                tok += [self.END] * depth
                page += [p] * (len(w) + depth)
                block += [b] * (len(w) + depth)
                start += [i for i in range(len(w))] + [-1] * depth
        self.tok = np.array(tok, np.uint64)
        self.page, self.block, self.at = (np.array(x, np.int64) for x in (page, block, start))
        self.depth = depth

    def keys(self):
        """Positions whose next ``depth`` tokens count, and the hash of those tokens.

        A run shorter than ``depth`` counts only as a whole block.
        """
        n = len(self.tok)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        pad = np.concatenate([self.tok, np.full(self.depth, self.END, np.uint64)])
        h = window_hashes(pad, self.depth)[:n]
        full = np.concatenate([self.tok, np.full(self.depth, self.END, np.uint64)])[self.depth - 1:self.depth - 1 + n] != self.END
        return np.flatnonzero((self.at >= 0) & (full | (self.at == 0))), h


def _repeats(depth: int):
    """Per task: one row for each distinct run of each distinct page, from the suffix array
    of its pages: (host, key, page), the page as hash of its text; key null: the page itself.

    The text of a page is its plain one, or all outside its articles if there is none.
    """
    def run(batches):
        for b in batches:
            urls, pages = (b.column(k).to_pylist() for k in range(2))
            for s, e in chunks([p or "" for p in pages], 8 << 20):
                use, blocks, sigs, seen = [], [], [], set()
                for i in range(s, e):
                    out = [x for x in parse(pages[i] or "") if x[0] != ARTICLE]
                    text = "\n".join([t for r, t in out if r != CHROME] or [t for _, t in out])
                    sig = xxhash.xxh64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)
                    if text and (host_of(urls[i]), sig) not in seen:
                        seen.add((host_of(urls[i]), sig))
                        use.append(i)
                        blocks.append([t for _, t in out])
                        sigs.append(sig)
                st = Streams(blocks, depth)
                at, h = st.keys()
                if not len(at):
                    continue
                yield pa.RecordBatch.from_arrays(
                    [pa.array([host_of(urls[i]) for i in use]), pa.nulls(len(use), pa.int64()), pa.array(sigs, pa.int64())],
                    names=["host", "key", "page"])
                # host before token: runs of one host lie together in the suffix order
                names = {x: k for k, x in enumerate(sorted({host_of(urls[i]) for i in use}))}
                host = np.array([names[host_of(urls[i])] for i in use], np.int64)
                order, rank = suffix_order(st.tok, depth)
                order = order[np.isin(order, at)]
                order = order[np.lexsort((st.page[order], rank[order], host[st.page[order]]))]
                group = np.stack([host[st.page[order]], rank[order], st.page[order]], 1)
                cut = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]).any(1)]))
                by = list(names)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([by[k] for k in group[cut, 0]]), pa.array(h[order[cut]].astype(np.int64)),
                     pa.array(np.array(sigs, np.int64)[group[cut, 2]])], names=["host", "key", "page"])
    return run


def _main(batches):
    """Per page: its article text, or its plain blocks where it declares no article."""
    for b in batches:
        ids, urls, pages, row = (b.column(k) for k in range(4))
        text, plain, keep = [], [], []
        for p in pages.to_pylist():
            blocks = parse(p or "")
            own = [(r, t) for r, t in blocks if r in (ARTICLE, DOUBT)]
            # a block to be tested for repeats, or kept as it is
            rest = [(t, r == ARTICLE) for r, t in own or blocks if r != CHROME]
            sure = all(k for _, k in rest)
            text.append("\n".join(t for t, _ in rest) if sure else None)
            plain.append(None if sure else [t for t, _ in rest])
            keep.append(None if sure else [k for _, k in rest])
        yield pa.RecordBatch.from_arrays([ids, urls, row, pa.array(text, pa.string()), pa.array(plain, pa.list_(pa.string())),
                                          pa.array(keep, pa.list_(pa.bool_())), pa.array([host_of(u) for u in urls.to_pylist()])],
                                         names=["page_id", "url", "row", "text", "plain", "keep", "host"])


def _keys(depth: int):
    def run(batches):
        for b in batches:
            st = Streams([["" if k else t for t, k in zip(*x)] for x in zip(b.column(2).to_pylist(), b.column(3).to_pylist())], depth)
            at, h = st.keys()
            page = st.page[at]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(page)), b.column(1).take(pa.array(page)), pa.array(h[at].astype(np.int64)),
                 pa.array(st.block[at]), pa.array(st.at[at])], names=["row", "host", "key", "block", "at"])
    return run


def long_runs(gone: np.ndarray, least: int) -> np.ndarray:
    """The covered tokens of a block that go: all if all are covered, else runs of ``least`` tokens at least."""
    if gone.all():
        return gone
    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
    out = np.zeros(len(gone), bool)
    for s, e in zip(edge[::2], edge[1::2]):
        out[s:e] = e - s >= least
    return out


def _unique(depth: int):
    """Plain blocks without their long covered runs; a block all covered goes."""
    def run(batches):
        for b in batches:
            out = []
            for blocks, hits in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                gone = [np.zeros(len(t.split()), bool) for t in blocks]
                for h in hits or []:
                    gone[h["block"]][h["at"]:h["at"] + depth] = True
                kept = [" ".join(w for w, g in zip(t.split(), long_runs(d, 2 * depth).tolist()) if not g) for t, d in zip(blocks, gone)]
                out.append("\n".join(k for k in kept if k))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], names=["page_id", "url", "text"])
    return run


def extract(pages: DataFrame, depth: int = 8, share: float = 0.25, least: int = 3) -> DataFrame:
    """One row per page: page_id, url, text (empty if none).

    Null html counts as empty.  Blocks are joined by a line feed; character references
    are decoded and white space inside a block is one space.  Pages with a null or odd
    url share the empty host.  Repeated rows get the same text each.  A run is boilerplate
    if ``least`` distinct pages of its host and more than ``share`` of them have it.
    """
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    # key null: the distinct pages of the host
    count = (src.select("url", "html").mapInArrow(_repeats(depth), "host string, key long, page long")
             .distinct().groupBy("host", "key").count().where((F.col("count") >= least) | F.col("key").isNull()))
    count = materialize(count)
    runs = (count.where("key is not null")
            .join(count.where("key is null").select("host", F.col("count").alias("pages")), "host")
            .where(F.col("count") > F.col("pages") * share).select("host", "key"))
    found = src.withColumn("row", F.xxhash64("page_id", "url", "html")).mapInArrow(
        _main, "page_id long, url string, row long, text string, plain array<string>, keep array<boolean>, host string")
    found = materialize(found)  # read three times below
    plain = found.where("plain is not null")
    hits = (plain.select("row", "host", "plain", "keep").dropDuplicates(["row"]).mapInArrow(
        _keys(depth), "row long, host string, key long, block long, at long")
        .join(runs, ["host", "key"], "left_semi")
        .groupBy("row").agg(F.collect_list(F.struct("block", "at")).alias("hits")))
    rest = (plain.join(hits, "row", "left").select("page_id", "url", "plain", "hits")
            .mapInArrow(_unique(depth), "page_id long, url string, text string"))
    return found.where("plain is null").select("page_id", "url", "text").unionByName(rest)


def extract_report(pages: DataFrame, **kw) -> DataFrame:
    """page_id, url, text, n_chars (code points)."""
    return extract(pages, **kw).withColumn("n_chars", F.length("text").cast("long"))
