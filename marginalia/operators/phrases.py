"""Words of several tokens against the positions of their tokens, where the documents lie.

Documents are dealt over slots, and inside a slot over parts. A slot has the postings of every token that some phrase names, each once and packed, and all
phrases; a phrase's rarest token says where it may start, and its other tokens' positions are searched for what must follow, a part after the other. Only what
matches leaves the slot.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.operators.packs import chunks, numbers, ordered, packed_columns, part_of, runs, small, unpacked_columns

# functions that run in tasks travel with the job: executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SLOT_TOKENS, LEAST_SLOTS = 16_000_000, 8  # tokens of the texts in a slot
SLOTS, MOST_TOKENS = 64, 32_000_000  # beyond so many slots they grow, since every phrase goes to each; packed, so many tokens are some hundred megabytes
SLOT_PARTS, PACK_ROWS = 2, 1_000_000  # a part's positions are unpacked at a time; postings packed at a time

_FOUND = "kind string, word string, field string, idf double, avgdl double, doc_id bigint, date timestamp, dl bigint, tf bigint"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings (field, token, doc_id, date, dl, positions) to packs of a part: documents once, and per posting a document's number and the gaps between positions."""
    for table in chunks(batches, PACK_ROWS):
        slots = table["slots"][0].as_py()
        table = table.combine_chunks()
        doc, at, dl = numbers(table["doc_id"]), numbers(table["date"]), numbers(table["dl"])
        part = part_of(doc, slots * SLOT_PARTS)
        order = np.argsort(part, kind="stable")
        lists = table["positions"].combine_chunks()
        sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), dtype=np.int64)
        places = ordered(sizes, np.asarray(pc.list_flatten(lists), dtype=np.int64), order)
        field, token = (table[c].combine_chunks().dictionary_encode() for c in ("field", "token"))
        code = np.asarray(field.indices, dtype=np.int64) * (len(token.dictionary) + 1) + np.asarray(token.indices, dtype=np.int64)
        doc, at, dl, part, sizes, code = (x[order] for x in (doc, at, dl, part, sizes, code))
        begins = np.append(0, np.cumsum(sizes))
        gaps = np.diff(places, prepend=0)
        full = begins[:-1][sizes > 0]
        gaps[full] = places[full]
        out, bounds = [], runs(part)
        for a, z in zip(bounds, bounds[1:]):
            by = np.lexsort((dl[a:z], at[a:z], doc[a:z])) + a
            one = runs(doc[by], at[by], dl[by])
            place = np.empty(z - a, np.int64)
            place[by - a] = np.repeat(np.arange(len(one) - 1), np.diff(one))
            one, heads = by[one[:-1]], runs(code[a:z])
            named = pa.array(order[a + heads[:-1]])
            columns = {"fields": table["field"].take(named).combine_chunks(), "names": table["token"].take(named).combine_chunks(), "sizes": small(np.diff(heads))}
            columns |= {"place": small(np.diff(place, prepend=0)), "tf": small(sizes[a:z]), "gaps": small(gaps[begins[a] : begins[z]])}
            columns |= {"docs": small(np.diff(doc[one], prepend=0)), "dates": table["date"].take(pa.array(order[one])).combine_chunks(), "dl": small(dl[one])}
            out.append(packed_columns(columns))
        own = part[bounds[:-1]]
        yield pa.RecordBatch.from_arrays([pa.array(own % slots, pa.int32()), pa.array(own, pa.int32()), pa.array(out, pa.binary())], ["slot", "part", "pack"])


def _stand(postings: pa.Table, phrases: pa.Table) -> pa.Table:
    asked = phrases.drop_columns(["slot"])
    lookups = asked.to_pylist()
    for p in lookups:
        p["terms"].sort(key=lambda t: t["i"])
    packs: dict[int, list[bytes]] = {}
    for part, pack in zip(postings["part"].to_pylist(), postings["pack"]):
        packs.setdefault(part, []).append(pack.as_py())
    found = [_in_part(packs[part], asked, lookups) for part in sorted(packs)]
    return pa.concat_tables(found) if found else _in_part([], asked, lookups)


def _in_part(packs: list[bytes], phrases: pa.Table, lookups: list[dict]) -> pa.Table:
    farthest = max((t["offset"] for p in lookups for t in p["terms"]), default=0)
    parts = [unpacked_columns(p) for p in packs]
    joined = lambda c: np.concatenate([np.zeros(0, np.int64), *[np.asarray(p[c], dtype=np.int64) for p in parts]])
    ids = np.concatenate([np.zeros(0, np.int64), *[np.cumsum(np.asarray(p["docs"], dtype=np.int64)) for p in parts]])
    dates = pa.chunked_array([p["dates"] for p in parts], None if parts else pa.timestamp("us", "UTC"))
    first = np.cumsum([0, *[len(p["docs"]) for p in parts]])
    source = np.concatenate([np.zeros(0, np.int64), *[np.cumsum(np.asarray(p["place"], dtype=np.int64)) + f for p, f in zip(parts, first)]])
    dl, sizes, gaps = joined("dl"), joined("tf"), joined("gaps")
    row = np.repeat(np.arange(len(sizes)), sizes)
    begins, total = (np.cumsum(sizes) - sizes)[sizes > 0], np.cumsum(gaps)
    at = total - np.repeat(total[begins] - gaps[begins], sizes[sizes > 0])
    named = (ids != np.iinfo(np.int64).min)[source]
    document = np.unique(ids, return_inverse=True)[1][source]
    wide = int(at.max(initial=0)) + farthest + 1  # a document's positions, and whatever may follow them
    place = document[row] * wide + at
    keys = [k for p in parts for k in zip(p["fields"].to_pylist(), p["names"].to_pylist())]
    codes: dict[tuple, int] = {}
    code = np.repeat(np.array([codes.setdefault(k, len(codes)) for k in keys], np.int64), joined("sizes"))[row]
    span = int(place.max(initial=0)) + 1
    order = np.argsort(code * span + place, kind="stable") if span * (len(codes) + 1) < 1 << 62 else np.lexsort((place, code))
    place, row, at, code = place[order], row[order], at[order], code[order]
    bounds = np.searchsorted(code, np.arange(len(codes) + 1))
    held = {k: slice(bounds[c], bounds[c + 1]) for k, c in codes.items()}
    which, rows, tf = [], [], []
    for i, p in enumerate(lookups):
        terms, field, anchor = p["terms"], p["field"], p["anchor"]
        own = held.get((field, anchor))
        others = {t["token"]: held.get((field, t["token"])) for t in terms}
        if own is None or None in others.values():
            continue
        first = next(t for t in terms if t["token"] == anchor)
        fits = at[own] >= first["offset"]
        if len(others) > 1:
            fits &= named[row[own]]  # no two tokens are known to be of one document without a number
        start, of = (place[own] - first["offset"])[fits], row[own][fits]
        for t in terms:
            if t is first or not len(start):
                continue
            other = place[others[t["token"]]]
            ok = other[np.minimum(np.searchsorted(other, start + t["offset"]), len(other) - 1)] == start + t["offset"]
            start, of = start[ok], of[ok]
        if len(of):
            one, n = np.unique(of, return_counts=True)
            which.append(np.full(len(one), i))
            rows.append(one)
            tf.append(n)
    which, rows, tf = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (which, rows, tf))
    word, of = pa.array(which, pa.int64()), source[rows]
    columns = [phrases[c].take(word) for c in ("kind", "word", "field", "idf", "avgdl")]
    columns += [pa.array(ids[of], mask=~named[rows]), dates.take(pa.array(of)), pa.array(dl[of]), pa.array(tf, pa.int64())]
    return pa.Table.from_arrays(columns, ["kind", "word", "field", "idf", "avgdl", "doc_id", "date", "dl", "tf"])


def standing(postings: DataFrame, phrases: DataFrame, field_stats: DataFrame) -> DataFrame:
    """kind, word, field, doc_id, date, dl, tf, idf, avgdl: the documents a phrase stands in, and how often.

    `postings` (field, token, doc_id, date, dl, positions) of the phrases' tokens; `phrases` have an anchor and terms (match.lookups()).
    """
    asks = lambda tokens: F.coalesce(F.ceil(F.sum("total_len") / tokens), F.lit(0))
    slots = field_stats.select(F.greatest(F.lit(LEAST_SLOTS), F.least(F.lit(SLOTS), asks(SLOT_TOKENS)), asks(MOST_TOKENS)).cast("int")).scalar()
    rows = postings.select("field", "token", "doc_id", "date", "dl", "positions", slots.alias("slots"))
    dealt = rows.mapInArrow(_pack, "slot int, part int, pack binary")
    asked = phrases.select("kind", "word", "field", "idf", "avgdl", "anchor", "terms").withColumn("slot", F.explode(F.sequence(F.lit(0), slots - 1)))
    return dealt.groupBy("slot").cogroup(asked.groupBy("slot")).applyInArrow(_stand, _FOUND)
