"""HTML extraction: the main text of web pages.

A page is read as a stream of tags and text. Markup names most of what is not
the article: menus, headers, footers, sidebars, notices, adverts, forms,
scripts and reader comments go by element, role and class. If the page marks
its article (``article``, ``main``, or a container named so), only the rest
of that is looked at.

Every page is then judged by a suffix array over the token streams of the
pages of its host: substrings of words that are repeated on many distinct
pages are found from the longest common prefixes, the spans of each page that
they cover are united, and blocks that are mostly covered are removed as
boilerplate; unique runs stay. Copies of a page count once. Inside a marked
article a substring has to be on half of the host's articles, at least
MARKED_PAGES, of which near copies count as one family; so passages that some
articles share, and near copies, stay. A marked article stays whole if
nothing would be left of it.

Hosts of any size are cut into groups of bounded size by a hash of the page,
so no group of pages of one host is gathered whole.

Defined results: null, empty and textless html give an empty text; unclosed
and stray tags are tolerated; ``br`` ends a block; repeated rows give
repeated results; a url without host is a host of its own. Extra columns of
the pages are dropped.
"""

from __future__ import annotations

import html as _html
import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrowtext as at
from .native import small
from .repetition import suffix_ranks

GROUP_BYTES = 4_000_000  # expected html of a group of one host
HOST_ROWS = 500_000  # bound for broadcasting the hosts' sizes
MIN_REPEAT = 4  # words of a repeated substring
MIN_PAGES = 3  # distinct pages of a group that must hold it, and
MIN_SHARE = 0.2  # the share of the group's pages
MARKED_PAGES = 5  # in marked articles: distinct families of pages, and
MARKED_SHARE = 0.5  # the share of the group's families
MOSTLY = 0.8  # covered share of a removed block

# Element names and the words of classes, ids and roles.
_DROP = set("head script style noscript template nav footer aside form button select textarea iframe svg canvas object menu dialog math audio video datalist".split())
_RAW = set("script style textarea title".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = set("address article aside blockquote body br caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
_CLOSES_P = _BLOCK - {"br", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "dd", "dt", "option", "optgroup", "li", "body", "html"}
_BAD = set(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion banner banners cookie cookies consent gdpr notice notices alert popup modal overlay newsletter "
    "subscribe subscription signup signin login sidebar side menu menus nav navbar navigation breadcrumb breadcrumbs footer foot masthead topbar toolbar comment comments reply replies disqus discussion respond "
    "share sharing social related recommended recommendations widget widgets pagination pager search copyright disclaimer paywall hidden contentinfo complementary skip tracking outbrain taboola".split()
)
_HEADER = {"header", "head"}
_MAIN = set("article main post entry story articlebody content".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?>[^"'>]++|"[^"]*+"|'[^']*+')*+)>|<[a-zA-Z/][^>]*+(?:>|\Z)|[^<]++|<""", re.S)
_ATTR = re.compile(r"""([^\s=/"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_SPLIT = re.compile(r"[^a-z0-9]+")
_WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*|[0-9]+")


@dataclass
class Block:
    text: str
    marked: bool  # inside a marked article
    link_chars: int
    path: str


@dataclass
class Page:
    blocks: list[Block] = field(default_factory=list)


def _names(attrs: str) -> tuple[set[str], bool, set[str]]:
    """Words of class, id and role; whether hidden; whole class and id names."""
    words: set[str] = set()
    whole: set[str] = set()
    hidden = False
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), a or b or c
        if name in ("class", "id", "role", "itemprop", "data-role"):
            for item in value.split():
                whole.add(item.lower())
                words.update(_SPLIT.split(item.lower()))
                words.update(w.lower() for w in _WORDS.findall(item))
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            hidden = True
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value.lower()):
            hidden = True
    return words, hidden, whole


def parse(source: str) -> Page:
    """The blocks of a page that its markup does not rule out."""
    page, stack = Page(), []  # of (name, dropped, marked, link)
    buffer: list[str] = []
    linked = 0
    dropped = marked = link = False
    skip_to = ""

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = " ".join(_html.unescape("".join(buffer)).split())
            if text:
                page.blocks.append(Block(text, marked, linked, "/".join(s[0] for s in stack[-4:])))
            buffer.clear()
        linked = 0

    def pop_to(i: int) -> None:
        nonlocal dropped, marked, link
        del stack[i:]
        dropped, marked, link = stack[-1][1:] if stack else (False, False, False)

    for m in _TOKEN.finditer(source):
        name = m.group(2)
        if name is None:
            piece = m.group()
            if piece[0] != "<" or piece == "<":
                if not dropped and not skip_to:
                    buffer.append(piece)
                    linked += len(piece) if link else 0
            continue
        name, closing = name.lower(), bool(m.group(1))
        if skip_to:
            if closing and name == skip_to:
                skip_to = ""
            continue
        if name in _BLOCK:
            flush()
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    pop_to(i)
                    break
                # A stray end tag does not close a section around it.
                if stack[i][0] in ("article", "main", "body") and name not in ("html", "body"):
                    break
            continue
        if name in _CLOSES_P or name in ("li", "dd", "dt", "td", "th", "tr", "option"):
            for i in range(len(stack) - 1, -1, -1):
                top = stack[i][0]
                if top == "p" and name in _CLOSES_P or top == name and name in ("li", "option", "td", "th", "tr", "dd", "dt"):
                    pop_to(i)
                    break
                if top in ("div", "article", "section", "main", "body", "ul", "ol", "dl", "table", "tr", "td", "aside", "nav", "footer", "header", "form", "blockquote"):
                    break
        if name in _VOID:
            continue
        attrs = m.group(3)
        if attrs.rstrip().endswith("/") and name not in _BLOCK:
            continue
        if name in _RAW and name != "title":
            skip_to = name
            continue
        bad = name in _DROP
        mark = marked
        if attrs.strip() and not bad and name not in ("html", "body"):
            words, hidden, whole = _names(attrs)
            bad = hidden or bool(words & _BAD) and not whole & _MAIN or not marked and bool(words & _HEADER) and not words & _MAIN
            if not bad and (whole & _MAIN or "main" in words or words & {"article", "post", "entry", "story"} and words & {"content", "body", "text"}):
                mark = True
        if name == "header" and not marked:
            bad = True
        if name in ("article", "main") and not bad:
            mark = True
        stack.append((name, dropped or bad, mark, link or name == "a"))
        dropped, marked, link = stack[-1][1:]
    flush()
    return page


def repeated(streams: list[list[np.ndarray]], least: int, share: float, families: bool = False) -> list[list[np.ndarray]]:
    """For each page's blocks of word hashes, which words lie in substrings
    of MIN_REPEAT words or more that so many of the distinct pages hold, or
    with ``families`` so many of their families.

    All streams form one sequence, with an end of its own after each block,
    so that no substring runs over a block.
    """
    flat = [b for page in streams for b in page]
    if not flat or len(streams) < least:
        return [[np.zeros(len(b), bool) for b in page] for page in streams]
    sizes = np.array([len(b) + 1 for b in flat])
    start = np.cumsum(sizes) - sizes
    seq = np.zeros(int(sizes.sum()), dtype=np.uint64)
    owner = np.repeat(np.repeat(np.arange(len(streams)), [len(p) for p in streams]), sizes)
    ends = np.zeros(len(seq), bool)
    for s, b in zip(start, flat):
        seq[s : s + len(b)] = b
        ends[s + len(b)] = True
    rank = np.unique(seq, return_inverse=True)[1].astype(np.int64)
    rank[ends] = rank.max() + 1 + np.arange(int(ends.sum()))
    levels = suffix_ranks(np.unique(rank, return_inverse=True)[1].astype(np.int64))
    # LCP intervals of at least MIN_REPEAT words: runs of suffixes whose
    # neighbours share so many; each counts the pages in it.
    sa = np.argsort(levels[-1])
    i, j = sa[:-1].copy(), sa[1:].copy()
    lcp = np.zeros(len(sa) - 1, dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        n = len(seq)
        ok = (np.maximum(i, j) < n) & (levels[k][np.minimum(i, n - 1)] == levels[k][np.minimum(j, n - 1)])
        lcp += ok << k
        i += ok << k
        j += ok << k
    run = np.concatenate([[0], np.cumsum(lcp < MIN_REPEAT)])
    if families:
        left = np.repeat(start + sizes - 1, sizes) - np.arange(len(seq))
        full = left[sa] >= MIN_REPEAT
        owner = family(run[full], owner[sa][full], len(streams))[owner]
    need = max(least, int(np.ceil(share * len(at.distinct(owner)))))
    pair = at.distinct(run * np.int64(len(streams)) + owner[sa])
    held = np.bincount(pair // len(streams), minlength=run[-1] + 1)
    hit = sa[held[run] >= need]
    covered = np.zeros(len(seq) + MIN_REPEAT + 1, dtype=np.int64)
    np.add.at(covered, hit, 1)
    np.add.at(covered, hit + MIN_REPEAT, -1)
    inside = np.cumsum(covered)[: len(seq)] > 0
    out, k = [], 0
    for page in streams:
        out.append([inside[start[k + q] : start[k + q] + len(b)] for q, b in enumerate(page)])
        k += len(page)
    return out


def family(run: np.ndarray, owner: np.ndarray, pages: int) -> np.ndarray:
    """The first page of each page's family. Near copies are of one family:
    pages that share half of the substrings of the smaller one or more.

    Each page is held against the next one that has the same substring, so
    this is linear in the words.
    """
    pair = at.distinct(run * np.int64(pages) + owner)
    run, owner = pair // pages, pair % pages
    size = np.bincount(owner, minlength=pages)
    same = run[1:] == run[:-1]
    link, shared = np.unique(owner[:-1][same] * np.int64(pages) + owner[1:][same], return_counts=True)
    a, b = link // pages, link % pages
    near = 2 * shared >= np.minimum(size[a], size[b])
    root = list(range(pages))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(a[near].tolist(), b[near].tolist()):
        x, y = find(x), find(y)
        root[max(x, y)] = min(x, y)
    return np.array([find(x) for x in range(pages)], dtype=np.int64)


def extract_group(sources: list[str | None]) -> list[str]:
    """The main texts of a group of pages of one host. Every page goes
    through a suffix array: with the pages that mark their article or with
    those that do not."""
    texts = [""] * len(sources)
    kinds: tuple[dict, dict] = {}, {}  # for each distinct page its copies: place and blocks
    for i, s in enumerate(sources):
        blocks = parse(s or "").blocks
        inside = [b for b in blocks if b.marked]
        key = "\n".join(b.text for b in inside or blocks)
        kinds[bool(inside)].setdefault(key, []).append((i, inside or blocks))
    for marked, found in enumerate(kinds):
        streams = [[at.mix(np.array([hash_word(w) for w in b.text.split()], dtype=np.uint64)) for b in copies[0][1]] for copies in found.values()]
        cover = repeated(streams, *((MARKED_PAGES, MARKED_SHARE, True) if marked else (MIN_PAGES, MIN_SHARE)))
        for copies, covered in zip(found.values(), cover):
            for i, blocks in copies:
                kept = [b.text for b, c in zip(blocks, covered) if c.mean() < MOSTLY and (marked or b.link_chars <= 0.6 * len(b.text))]
                if marked and not kept:
                    kept = [b.text for b in blocks]
                texts[i] = "\n".join(kept)
    return texts


def hash_word(word: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word)


def extract(pages: DataFrame, html: str = "html", url: str = "url", id_column: str = "page_id") -> DataFrame:
    """id, url, text, n_chars of each page."""
    rows = pages.select(F.col(id_column), F.col(url).alias("url"), F.col(html).alias("html"))
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1))
    host = F.when(host == "", F.coalesce("url", F.lit(""))).otherwise(host)
    rows = rows.withColumn("host", host)
    sizes = rows.groupBy("host").agg(F.sum(F.coalesce(F.octet_length("html"), F.lit(0))).alias("bytes"))
    parts = sizes.select("host", F.greatest(F.lit(1), F.ceil(F.col("bytes") / GROUP_BYTES)).cast("int").alias("parts"))
    rows = rows.join(small(parts, HOST_ROWS), "host")
    rows = rows.withColumn("part", F.pmod(F.xxhash64(F.col(id_column).cast("string"), "url"), F.col("parts")))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        texts = extract_group([s if isinstance(s, str) else None for s in group["html"]])
        return pd.DataFrame({id_column: group[id_column], "url": group["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    kind = dict(rows.dtypes)[id_column]
    return rows.drop("parts").groupBy("host", "part").applyInPandas(run, f"{id_column} {kind}, url string, text string, n_chars bigint")
