"""License scans: fuzzy short-notice search. Exact seeds by the pigeonhole rule locate candidates; the regex library's
bounded-error matching verifies them and reports spans."""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placelark.llm.common import table, values

# The words of a text, and the phrases with their labels.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Notices searched with errors, beside the base phrases of ten characters or more; an error is allowed for each PER_ERROR characters.
NOTICES = {**{p: k for p, k in BASE.items() if len(p) >= 10}, "creative commons attribution": "cc-by", "mozilla public license": "mpl", "bsd license": "bsd", "gnu lesser general public license": "lgpl", "licensed under the apache": "apache", "released under the mit": "mit"}
PER_ERROR = 9
_word, _gap = re.compile(WORD), re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_lower = {i: i + 32 for i in range(65, 91)}


def scanner(base: dict[str, str] = BASE, notices: dict[str, str] = NOTICES, per_error: int = PER_ERROR):
    """A function from a text to (n_words, n_base, first_word, last_word, base labels, labels, score, spans)."""
    seeds = ahocorasick.Automaton()
    fuzzy = []
    where: dict[str, list] = {}
    for phrase, label in notices.items():
        k = len(phrase) // per_error
        cuts = [len(phrase) * i // (k + 1) for i in range(k + 2)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            where.setdefault(phrase[a:b], []).append((len(fuzzy), a))
        # the first match, then the best fit of it: each notice of a window is a span of its own
        fuzzy.append((phrase, label, k, regex.compile(rf"(?e)(?<![^ ])(?:{regex.escape(phrase)}){{e<={k}}}(?![^ ])")))
    for s, w in where.items():
        seeds.add_word(s, (len(s), w))
    seeds.make_automaton()
    padded = {f" {p} ": v for p, v in base.items()}

    def scan(text: str | None):
        flat = _gap.sub(" ", (text or "").translate(_lower)).strip(" ")
        n_words = flat.count(" ") + 1 if flat else 0
        line = f" {flat} "
        starts, base_labels = [], set()
        for p, label in padded.items():
            at, before, n = line.find(p), 0, 0
            while at >= 0:
                n += line.count(" ", before, at)  # words before, counted once
                before = at
                starts.append(n)
                base_labels.add(label)
                at = line.find(p, at + 1)
        tried: dict[int, list[int]] = {}
        for end, (n, w) in seeds.iter(flat):
            for i, a in w:
                tried.setdefault(i, []).append(end + 1 - n - a)
        spans = []
        for i, offsets in tried.items():
            phrase, label, k, pattern = fuzzy[i]
            windows: list[list[int]] = []
            for s in sorted(offsets):
                lo, hi = max(0, s - k), min(len(flat), s + len(phrase) + k)
                lo = flat.rfind(" ", 0, lo) + 1  # from a word's begin to a word's end
                end = flat.find(" ", hi)
                hi = end if end >= 0 else len(flat)
                if windows and lo <= windows[-1][1]:
                    windows[-1][1] = max(hi, windows[-1][1])
                else:
                    windows.append([lo, hi])
            for lo, hi in windows:
                for m in pattern.finditer(line, lo, hi + 1):  # from the space before: the library inserts nothing where a search begins
                    spans.append((m.start() - 1, m.end() - 1, label, sum(m.fuzzy_counts), 1 - sum(m.fuzzy_counts) / len(phrase)))
        score = 1.0 if base_labels else max((x[4] for x in spans), default=0.0)
        return n_words, len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base_labels)), ",".join(sorted(base_labels | {x[2] for x in spans})), score, sorted(spans)

    return scan


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base=BASE, notices=NOTICES, per_error: int = PER_ERROR) -> DataFrame:
    """One row per row of docs: (id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans).

    Spans are code points of the words joined by single spaces, with label and edits; a window of seeds gives all its
    matches, not the best alone. Map-only: each whole text is read once, and a very long one is held alone. A null or empty
    text has no words, empty labels and score 0; ids may be null or repeat, and other columns are ignored. An empty table gives no rows.
    """
    kinds = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64()}
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string()), ("edits", pa.int32())]))

    def run(batches):
        scan = scanner(base, notices, per_error)
        for batch in batches:
            *columns, spans = zip(*(scan(t) for t in values(batch, "_t")), strict=True) if batch.num_rows else [()] * (len(kinds) + 1)
            spans = [[{"start": s, "end": e, "label": x, "edits": n} for s, e, x, n, _ in row] for row in spans]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(spans, span), batch.column("_id")], [*kinds, "spans", "_id"])

    schema = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<start:int,end:int,label:string,edits:int>>, _id long"
    got = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_t")).mapInArrow(run, schema)
    return got.select(F.col("_id").alias(id_col), *kinds, "spans")


def op3_license_scan(spark, sf_dir):
    return scan_licenses(table(spark, sf_dir, "documents"))
