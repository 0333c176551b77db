"""HTML extraction by equivalence classes of tokens.

A token is an element, or a whole block of text, with its path of elements. Its occurrence vector, its count on each page of a
host, is held as (pages, a sum of hashes of page and count): equal vectors have equal sums, and sums combine map-side. Pages of a
host with equal content count as one. Tokens of one host with equal vectors are a class; a class that occurs on enough of the
host's pages is valid. Elements of valid classes that occur once a page nest by their paths into the template; text that is no
block of a valid class lies in its slots. The deepest node of the template above all slots bounds the text: everything in it is
extracted, without boilerplate elements and without blocks of valid classes, unless a page holds nothing else.
"""

from __future__ import annotations

import html as html_lib
import pickle
import re
import zlib

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placelark.llm.common import table, values, written

# Elements without content, elements inside a line of text, raw elements, and boilerplate.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr label".split())
RAW = frozenset("script style noscript template textarea title svg math iframe object select option button".split())
DROP = frozenset("nav header footer aside form menu dialog head".split())
NAMES = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|sidebar|side|footer|header|masthead|breadcrumbs?|cookies?|consent|notice|popup|modal|newsletter|subscribe|share|social|related|recommended|comments?|replies|disqus|widget|toolbar|skip)(?:$|[\s_-])", re.I)
MAIN = re.compile(r"^(?:article|main)\b")
PIECE = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][\w:-]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>", re.S)
ATTR = re.compile(r"\b(class|id|role|hidden|style|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
HOST = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/@]*@)?([^/?#:]+)", re.I)
#: A class is valid on this share of a host's pages, and on so many pages at least.
SUPPORT, MIN_PAGES = 0.9, 5
#: Templates up to this size are broadcast. Beyond it they are shuffled, and a host with more than this share of all pages (there are fewer
#: such hosts than its inverse) is dealt to keys of SALT_PAGES pages.
BROADCAST_BYTES, HOT_SHARE, SALT_PAGES = 32 << 20, 1e-3, 4096


def host_of(url: str | None) -> str:
    m = HOST.match(url or "")
    return m[1].lower() if m else ""


def blocks(source: str | None, opened: dict[int, str] | None = None) -> list[tuple[str, bool, str]]:
    """(path, boilerplate, text) of each block in page order. Broken nesting ends at the nearest open element of the name.
    `opened` takes the paths of the elements that hold text, by where they begin."""
    out: list[tuple[str, bool, str]] = []
    stack: list[tuple[str, str, bool, int]] = []
    text: list[str] = []
    source = source or ""
    at, n = 0, len(source)

    def end_block():
        if text:
            flat = " ".join(html_lib.unescape("".join(text)).split())
            text.clear()
            if flat:
                out.append(("/".join(x[1] for x in stack), any(x[2] for x in stack), flat))
                if opened is not None:
                    for i in range(len(stack) - 1, -1, -1):
                        if stack[i][3] in opened:
                            break
                        opened[stack[i][3]] = "/".join(x[1] for x in stack[: i + 1])

    while at < n:
        m = PIECE.search(source, at)
        if not m:
            text.append(source[at:] if "<" not in source[at:] or not re.search(r"<[a-zA-Z/!]", source[at:]) else re.split(r"<[a-zA-Z/!]", source[at:], maxsplit=1)[0])
            break
        if m.start() > at:
            text.append(source[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag in INLINE:
            continue
        if tag == "br":
            text.append(" ")
            continue
        end_block()
        if m[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
            continue
        if tag in VOID:
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}\s*>", re.I).search(source, at)
            if tag in ("script", "style", "textarea", "title") or close:
                at = close.end() if close else n
            continue
        attrs = {k.lower(): (a or b or c or "") for k, a, b, c in ATTR.findall(m[3])}
        label = attrs.get("class", "") + " " + attrs.get("id", "")
        hidden = "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", attrs.get("style", ""), re.I) is not None
        bad = tag in DROP or hidden or bool(NAMES.search(label)) or attrs.get("role", "").lower() in ("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert")
        if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option"):  # these end an open one of their kind
            if stack and stack[-1][0] == tag or tag == "p" and stack and stack[-1][0] == "p":
                stack.pop()
        elif stack and stack[-1][0] == "p":
            stack.pop()
        if not m[3].rstrip().endswith("/"):
            stack.append((tag, tag + ("." + ".".join(sorted(label.split())) if label.strip() else ""), bad, at))
    end_block()
    return out


def bounded(own: list[tuple[str, bool, str]]) -> tuple[bool, list[tuple[str, str]]]:
    """(whether article or main bounds the page, its blocks that are no boilerplate, within those bounds)."""
    good = [(p, t) for p, bad, t in own if not bad]
    main = [(p, t) for p, t in good if any(MAIN.match(x) for x in p.split("/"))]
    return bool(main), main or good


def _hash(x: str) -> int:
    return xxhash.xxh64_intdigest(x) >> 1


def _pages(batches):
    """A page's content hash and packed tokens: (token, hash of a block's path or -1 for an element, path of an element, count, chars in
    slots of pages without article or main, chars in slots of others)."""
    for batch in batches:
        rows = []
        for url, source in zip(values(batch, "_u"), values(batch, "_h"), strict=True):
            opened: dict[int, str] = {}
            own = blocks(source, opened)
            is_main, slots = bounded(own)
            held: dict[tuple, list] = {}

            def add(key, n, chars):
                got = held.setdefault(key, [0, 0, 0])
                got[0] += n
                got[1 + is_main] += chars

            for path in opened.values():
                add((_hash(path), -1, path), 1, 0)
            for path, _, flat in own:
                add((_hash(f"{path}\0{flat}"), _hash(path), ""), 1, 0)
            for path, flat in slots:
                add((_hash(path), -1, path), 0, len(flat))
                add((_hash(f"{path}\0{flat}"), _hash(path), ""), 0, len(flat))
            content = _hash("\0".join(f"{p}\0{t}" for p, t in slots))
            rows.append((host_of(url), content, zlib.compress(pickle.dumps([(*k, *v) for k, v in held.items()]), 1)))
        columns = zip(*rows, strict=True) if rows else [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.binary()), strict=True)], ["host", "content", "tokens"])


def _tokens(batches):
    """Occurrence sums of a chunk's tokens, by host: (host, token, at, path, pages, hits, vector, chars, main_chars)."""
    held: dict[tuple, list] = {}

    def flush():
        rows = [(*k, *v) for k, v in held.items()]
        held.clear()
        return pd.DataFrame(rows, columns=["host", "token", "at", "path", "pages", "hits", "vector", "chars", "main_chars"])

    for pdf in batches:
        for host, content, packed in zip(pdf["host"], pdf["content"], pdf["tokens"], strict=True):
            vectors: dict[int, int] = {}
            for token, at, path, n, chars, main_chars in [(-1, -1, "", 1, 0, 0), *pickle.loads(zlib.decompress(packed))]:
                if n not in vectors:
                    vectors[n] = _hash(f"{content} {n}") >> 23
                got = held.setdefault((host, token, at, path), [0, 0, 0, 0, 0])
                for i, x in enumerate((1, n, vectors[n], chars, main_chars)):
                    got[i] += x
        if len(held) > 200_000:
            yield flush()
    if held:
        yield flush()


def _cut(batches):
    for batch in batches:
        out, within = [], []
        for source, path, main_path, fixed in zip(*(values(batch, c) for c in ("_h", "_path", "_main", "_fixed")), strict=True):
            is_main, good = bounded(blocks(source))
            within.append(main_path if is_main else path)
            if not is_main and path:
                good = [(p, t) for p, t in good if p == path or p.startswith(path + "/")] or good
            if fixed:
                gone = set(fixed)
                good = [(p, t) for p, t in good if _hash(f"{p}\0{t}") not in gone] or good
            out.append(" ".join(t for _, t in good))
        columns = pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64()), pa.array(within, pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("_p"), batch.column("_u"), *columns], ["_p", "_u", "text", "n_chars", "template"])


def _template(tokens: DataFrame) -> DataFrame:
    """(host, _path, _main, _fixed): the template's node above all slots of pages without article or main, that of the others, and the
    blocks of valid classes; hosts of MIN_PAGES pages at least."""
    hosts = tokens.filter((F.col("token") == -1) & (F.col("pages") >= MIN_PAGES)).select("host", F.col("pages").alias("n"))
    tokens = tokens.filter("token <> -1")
    valid = tokens.join(hosts, "host").filter(F.col("pages") >= F.col("n") * SUPPORT)
    classes = valid.groupBy("host", "pages", "vector").agg(F.count(F.lit(1)).alias("members")).filter("members >= 2").drop("members")
    fixed = valid.filter("at <> -1").join(classes, ["host", "pages", "vector"], "left_semi")
    inside = fixed.groupBy("host", F.col("at").alias("token")).agg(F.sum("chars").alias("_c"), F.sum("main_chars").alias("_m"))
    # a path is a slot's if it has more text than that of valid classes; what all paths begin with, the first and the last do
    slots = tokens.filter("at = -1 AND chars + main_chars > 0").join(hosts, "host", "left_semi").join(inside, ["host", "token"], "left")
    left = lambda c, gone: F.when(F.col(c) > F.coalesce(gone, F.lit(0)), F.concat("path", F.lit("/")))
    ends = slots.select("host", left("chars", "_c").alias("s"), left("main_chars", "_m").alias("m")).groupBy("host").agg(F.min("s").alias("s0"), F.max("s").alias("s1"), F.min("m").alias("m0"), F.max("m").alias("m1"))
    nodes = valid.filter("at = -1 AND hits = pages").select("host", "path")
    above = lambda a, b: F.max(F.when(F.col(a).startswith(F.concat("path", F.lit("/"))) & F.col(b).startswith(F.concat("path", F.lit("/"))), F.struct(F.length("path").alias("l"), "path")))["path"]
    found = ends.join(nodes, "host").groupBy("host").agg(above("s0", "s1").alias("_path"), above("m0", "m1").alias("_main"))
    blocks_of = fixed.groupBy("host").agg(F.collect_list("token").alias("_fixed"))
    return hosts.join(found, "host", "left").join(blocks_of, "host", "left").withColumn("_path", F.coalesce("_path", F.lit(""))).withColumn("_main", F.coalesce("_main", F.lit("")))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of pages: (page_id, url, text, n_chars, template: the path of the template's node that bounds the page's text,
    empty for the root, null for hosts of few pages).

    A null or empty page has the empty text; pages without a host form one host. Templates are broadcast while they are small,
    by their measured size; else they meet the pages in a shuffled join in which a host with many pages has many keys. Tokens are
    summed map-side and no page meets another. Pages with the same content, repeated rows among them, count as one page in the
    template, and each gives its row. A very long page is parsed alone; other columns are ignored. An empty table gives no rows.
    """
    p = pages.select(F.col(id_col).cast("long").alias("_p"), F.col(url_col).alias("_u"), F.col(html_col).alias("_h"))
    distinct = p.select("_u", "_h").mapInArrow(_pages, "host string, content long, tokens binary").groupBy("host", "content").agg(F.min("tokens").alias("tokens"))
    sums = distinct.mapInPandas(_tokens, "host string, token long, at long, path string, pages long, hits long, vector long, chars long, main_chars long")
    total = sums.groupBy("host", "token", "at", "path").agg(*[F.sum(c).alias(c) for c in ("pages", "hits", "vector", "chars", "main_chars")])
    tokens = written(total.filter((F.col("pages") >= MIN_PAGES) | (F.col("at") == -1) & (F.col("chars") + F.col("main_chars") > 0)), "tokens")
    template = written(_template(tokens), "templates")
    host = F.lower(F.coalesce(F.regexp_extract(F.coalesce("_u", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/?#:]+)", 1), F.lit("")))
    keyed = p.withColumn("host", host)
    size = template.agg(F.sum(F.length("host") + F.length("_path") + F.length("_main") + 8 * F.coalesce(F.size("_fixed"), F.lit(0)) + 64)).first()[0] or 0
    met = keyed.join(F.broadcast(template), "host", "left") if size <= BROADCAST_BYTES else _salted(keyed, template)
    out = met.select("_p", "_u", "_h", "_path", "_main", "_fixed").mapInArrow(_cut, "_p long, _u string, text string, n_chars long, template string")
    return out.select(F.col("_p").alias(id_col), F.col("_u").alias(url_col), "text", "n_chars", "template")


def _salted(keyed: DataFrame, template: DataFrame) -> DataFrame:
    """keyed with the columns of its host's template, in a shuffled join; `copies` counts pages of a host however often they repeat."""
    n = keyed.groupBy("host").agg(F.count(F.lit(1)).alias("copies"))
    most = (keyed.count() or 1) * HOT_SHARE
    hot = F.broadcast(n.filter(F.col("copies") > most).select("host", F.ceil(F.col("copies") / SALT_PAGES).cast("int").alias("_salts")))
    spread = template.join(hot, "host", "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    own = keyed.join(hot, "host", "left").withColumn("_salt", F.pmod(F.xxhash64("_p", "_u", "_h"), F.coalesce("_salts", F.lit(1))).cast("int")).drop("_salts")
    return own.join(spread.hint("shuffle_hash"), ["host", "_salt"], "left")


def op1_html_extract(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages"))
