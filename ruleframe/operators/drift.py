"""Schemas that drift between files: profile, match versions, report changes, read all files as one table.

Records carry a JSON object. They are exchanged once, by series (and, in a series with a large part of all records, by
record too), so that the copies of a record, its neighbours in other files and the profile of a file meet without another
exchange; from then on only one row a series, file and field is handled. A field's value sketch is keyed by record: a
count, and the exclusive-or of hashes of (record, value), over the records that the file shares with its neighbour.

A change of files is a bipartite graph of the fields that stop and those that start. Equal sketches mean equal values
record by record; only such pairs can be renames, so the similarity matrix falls into blocks of equal sketches. Each
block is solved as an assignment of the largest total similarity of names and types.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Sequence
from difflib import SequenceMatcher
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ruleframe.errors import RuleError
from ruleframe.operators.sizes import heavy_keys, small
from ruleframe.storage import cut

#: In this order the bits of a field's kinds.
_TYPES = ("string", "number", "boolean", "array", "object")
#: Parts into which a series with a large share of all records is cut.
SALTS = 64


def _kind(text: Column) -> Column:
    """The bit of a JSON value's type, told by its first character; 0 for null."""
    first = F.substring(text, 1, 1)
    return F.when(first == '"', 1).when(first == "{", 16).when(first == "[", 8).when(first.isin("t", "f"), 4).when(first == "n", 0).otherwise(2)


def _names(mask: Column) -> Column:
    return F.concat_ws(",", *[F.when(mask.bitwiseAND(F.lit(1 << k)) != 0, t) for k, t in enumerate(_TYPES)])


def parse(rows: DataFrame, series: str, file: str, record_key: str, record: str, arrived: str | None = None) -> DataFrame:
    """(``series``, ``salt``, ``file``, ``rec``, ``seen_before``, ``seen_after``, ``json``) with one row a record of a file.

    Of records sent twice the one that arrived last holds (of equal arrivals, the one with the larger text).
    ``seen_before`` and ``seen_after`` are the nearest other files of the series with that record. Text that is no JSON
    object gives a record without fields; records without a series or file are left out; those without a key are all
    kept, sent twice or not, and never compared; their fields count as present in their file.
    """
    last = F.struct(F.col(arrived) if arrived else F.lit(0), F.col(record))
    live = rows.select(F.col(series).alias("series"), F.col(file).alias("file"), F.col(record_key).alias("rec"), F.col(record).alias("json"), last.alias("last")).where("series is not null and file is not null")
    counted = cut(live.groupBy("series").agg(F.count("*").alias("n")))
    heavy = F.broadcast(heavy_keys(counted, ["series"], "n", share=0.005).withColumn("hot", F.lit(True)))
    part = F.when(F.col("hot"), F.pmod(F.when(F.col("rec").isNotNull(), F.xxhash64("rec")).otherwise(F.xxhash64("json")), F.lit(SALTS))).otherwise(0)
    live = live.join(heavy, "series", "left").withColumn("salt", part.cast("int")).drop("hot").repartition("series", "salt")
    one = live.where("rec is not null").groupBy("series", "salt", "rec", "file").agg(F.max_by("json", "last").alias("json"))
    w = W.partitionBy("series", "salt", "rec").orderBy("file")
    keyed = one.withColumns({"seen_before": F.lag("file").over(w), "seen_after": F.lead("file").over(w)})
    never = F.lit(None).cast(live.schema["file"].dataType)
    names = ["series", "salt", "file", "rec", "seen_before", "seen_after", "json"]
    return keyed.select(*names).unionByName(live.where("rec is null").drop("last").withColumns({"seen_before": never, "seen_after": never}).select(*names))


def _fields(json: Column) -> Column:
    return F.from_json(json, "map<string, variant>")


def profile(records: DataFrame) -> DataFrame:
    """One row a (series, salt, file, field, seen_before, seen_after): bits of the kinds met, values, keyed value sketch.
    A file's records without fields show as a null field."""
    cells = records.select("series", "salt", "file", "rec", "seen_before", "seen_after", F.explode_outer(_fields(F.col("json"))).alias("field", "v"))
    cells = cells.withColumn("text", F.to_json("v")).withColumn("kind", _kind(F.col("text")))
    number = F.when(F.col("kind") == 2, F.expr("try_cast(text as decimal(38, 12))"))
    value = F.when(F.col("kind") > 0, F.xxhash64("rec", "kind", F.coalesce(number.cast("string"), F.col("text"))))
    return cells.groupBy("series", "salt", "file", "field", "seen_before", "seen_after").agg(F.count(value).alias("n"), F.coalesce(F.bit_xor(value), F.lit(0)).alias("x"), F.coalesce(F.bit_or("kind"), F.lit(0)).alias("kinds"))


def _plain(name: str) -> str:
    words = re.sub(r"([a-z])([A-Z])", r"\1_\2", name).lower()
    return re.sub(r"(_?v)?\d*$", "", re.sub(r"[\W_]+", "_", words).strip("_"))


def _plain_column(name: Column) -> Column:
    """``_plain`` of a column."""
    words = F.lower(F.regexp_replace(name, r"([a-z])([A-Z])", "$1_$2"))
    joined = F.regexp_replace(F.regexp_replace(words, r"[^\p{L}\p{N}]+", "_"), r"^_+|_+$", "")
    return F.regexp_replace(joined, r"(_?v)?\d*$", "")


def name_similarity(a: str, b: str) -> float:
    """0 to 1; spelling style, case, version endings and outer spaces don't count."""
    return SequenceMatcher(None, _plain(a), _plain(b)).ratio()


def assign(gain: Sequence[Sequence[float]]) -> list[tuple[int, int]]:
    """Pairs (row, column) of an assignment of the smaller side with the largest total gain (shortest augmenting paths)."""
    cost = -np.asarray(gain, dtype=float)
    if cost.size == 0:
        return []
    turned = cost.shape[0] > cost.shape[1]
    cost = cost.T if turned else cost
    n, m = cost.shape
    row_price, col_price, mate = np.zeros(n), np.zeros(m), np.full(m, -1)
    for start in range(n):
        best, come, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, dtype=bool)
        row, at = start, -1
        while True:
            slack = cost[row] - row_price[row] - col_price
            better = ~done & (slack < best)
            best[better], come[better] = slack[better], at
            to = int(np.argmin(np.where(done, np.inf, best)))
            step = best[to]
            row_price[start] += step
            row_price[mate[done]] += step
            col_price[done] -= step
            best[~done] -= step
            done[to], at = True, to
            if mate[to] < 0:
                break
            row = mate[to]
        while at >= 0:
            before = come[at]
            mate[at] = mate[before] if before >= 0 else start
            at = before
    pairs = [(int(mate[j]), j) for j in range(m) if mate[j] >= 0]
    return sorted((j, i) if turned else (i, j) for i, j in pairs)


def similarity(stop: tuple[str, int], start: tuple[str, int]) -> float:
    """Of two fields (name, kinds) with equal values."""
    return 1 + name_similarity(stop[0], start[0]) + 0.1 * (stop[1] == start[1])


def match(stops: Sequence[tuple], starts: Sequence[tuple]) -> dict[int, int]:
    """Which stopped field (``name``, ``kinds``, ``n``, ``x``) goes on as which started one, by their places.

    Pairs of different sketches have no similarity, so the matrix is solved block by block.
    """
    blocks: dict[tuple, tuple[list[int], list[int]]] = defaultdict(lambda: ([], []))
    for side, fields in enumerate((stops, starts)):
        for k, f in enumerate(fields):
            blocks[f[2], f[3]][side].append(k)
    pairs: dict[int, int] = {}
    for i, j in blocks.values():
        if len(i) == len(j) == 1:
            pairs[i[0]] = j[0]
        elif i and j:
            found = assign([[similarity(stops[a][:2], starts[b][:2]) for b in j] for a in i])
            pairs |= {i[a]: j[b] for a, b in found}
    return pairs


def _matched(groups: pd.DataFrame) -> pd.DataFrame:
    rows = []
    for r in groups.itertuples(index=False):
        stops, starts = ([(x["field"], x["kinds"], x["n"], x["x"]) for x in side] for side in (r.stops, r.starts))
        pairs = match(stops, starts)
        rows += [(r.series, r.file, f[0], "renamed", starts[pairs[k]][0]) if k in pairs else (r.series, r.file, f[0], "removed", "") for k, f in enumerate(stops)]
        goes_on = set(pairs.values())
        rows += [(r.series, r.file, f[0], "added", "") for k, f in enumerate(starts) if k not in goes_on]
    return pd.DataFrame(rows, columns=["series", "file", "field", "change", "new_field"])


def changes(records: DataFrame) -> DataFrame:
    """(``series``, ``file``, ``field``, ``change``, ``new_field``): each change against the last earlier file of the series.

    ``renamed``: a field stops, another starts, and all records in both files have equal values in them (null and
    missing are equal); else ``removed`` and ``added``; ``retyped``: the non-null values are of other JSON types.
    """
    prof = cut(profile(records))
    w = W.partitionBy("series").orderBy("file")
    files = prof.select("series", "file").distinct().select("series", "file", F.row_number().over(w).alias("k"), F.lag("file").over(w).alias("prev"), F.lead("file").over(w).alias("next"))
    placed = prof.where("field is not null").join(small(cut(files)), ["series", "file"])
    # sketches over the records that both files of a transition have
    shared = lambda c, other: (F.coalesce(F.sum(F.when(F.col(c) == F.col(other), F.col("n"))), F.lit(0)).alias(f"n_{other}"), F.coalesce(F.bit_xor(F.when(F.col(c) == F.col(other), F.col("x"))), F.lit(0)).alias(f"x_{other}"))
    present = placed.groupBy("series", "field", "file", "k", "prev", "next").agg(F.bit_or("kinds").alias("kinds"), *shared("seen_before", "prev"), *shared("seen_after", "next"))
    v = W.partitionBy("series", "field").orderBy("k")
    present = cut(present.withColumns({"k0": F.lag("k").over(v), "k1": F.lead("k").over(v), "kinds0": F.lag("kinds").over(v)}))

    def side(rows: DataFrame, file: str, sketch: str, name: str) -> DataFrame:
        """The fields that start or stop between two files, one row a transition; at most the fields of one file."""
        field = F.struct("field", "kinds", F.col(f"n_{sketch}").alias("n"), F.col(f"x_{sketch}").alias("x"))
        return rows.groupBy("series", F.col(file).alias("file")).agg(F.sort_array(F.collect_list(field)).alias(name))

    starts = side(present.where("prev is not null and (k0 is null or k0 < k - 1)"), "file", "prev", "starts")
    stops = side(present.where("next is not null and (k1 is null or k1 > k + 1)"), "next", "next", "stops")
    met = cut(starts.join(stops, ["series", "file"], "full"))
    kind = records.schema
    schema = f"series {kind['series'].dataType.simpleString()}, file {kind['file'].dataType.simpleString()}, field string, change string, new_field string"
    both = met.where("starts is not null and stops is not null").mapInPandas(lambda batches: (_matched(b) for b in batches), schema)
    none = F.lit("").alias("new_field")
    alone = lambda here, other, what: met.where(f"{other} is null").select("series", "file", F.explode(f"{here}.field").alias("field"), F.lit(what).alias("change"), none)
    retyped = present.where("k0 = k - 1 and kinds <> 0 and kinds0 <> 0 and kinds <> kinds0").select("series", "file", "field", F.lit("retyped").alias("change"), none)
    return both.unionByName(alone("starts", "stops", "added")).unionByName(alone("stops", "starts", "removed")).unionByName(retyped)


def _final_names(groups: pd.DataFrame) -> pd.DataFrame:
    """The last name of every renamed field, for the files in which it had an earlier one."""
    out = []
    for g in groups.itertuples(index=False):
        live: dict[str, str] = {}
        for file, field, new in zip(reversed(g.files), reversed(g.fields), reversed(g.new_fields)):
            final = live.pop(new, new)
            out.append((g.series, field, file, final))
            live[field] = final
    return pd.DataFrame(out, columns=["series", "field", "until", "final"])


def unify(records: DataFrame, found: DataFrame) -> DataFrame:
    """All records of all files in one table: (``series``, ``file``, ``rec``, ``fields``), ``fields`` mapping each field's
    last name to its value as JSON text, whatever it was called in that file.

    Where a name comes up again for another field after a rename, each file's own renames decide. Two fields under one
    name in one file: the later one's value holds.
    """
    kind = records.schema
    s, f = kind["series"].dataType.simpleString(), kind["file"].dataType.simpleString()
    renames = found.where("change = 'renamed'").select("series", "file", "field", "new_field")
    # one row a series, with its few renames in the order of its files
    events = renames.groupBy("series").agg(F.sort_array(F.collect_list(F.struct("file", "field", "new_field"))).alias("e"))
    events = events.select("series", F.col("e.file").alias("files"), F.col("e.field").alias("fields"), F.col("e.new_field").alias("new_fields"))
    final = cut(events.mapInPandas(lambda batches: (_final_names(b) for b in batches), f"series {s}, field string, until {f}, final string"))
    files = records.select("series", "file").distinct().join(final, "series").where("file < until")
    w = W.partitionBy("series", "file", "field").orderBy("until")
    per_file = files.withColumn("nth", F.row_number().over(w)).where("nth = 1").groupBy("series", "file").agg(F.map_from_entries(F.collect_list(F.struct("field", "final"))).alias("names"))
    named = records.join(small(cut(per_file)), ["series", "file"], "left").withColumn("given", F.map_entries(F.transform_values(_fields(F.col("json")), lambda _, v: F.to_json(v))))
    entries = F.transform("given", lambda x: F.struct(F.coalesce(F.try_element_at("names", x["key"]), x["key"]).alias("key"), x["value"].alias("value")))
    named = named.withColumn("entries", F.when(F.col("names").isNull(), F.col("given")).otherwise(entries))
    folded = F.aggregate("entries", F.create_map().cast("map<string, string>"), lambda m, x: F.map_concat(F.map_filter(m, lambda k, _: k != x["key"]), F.map_from_arrays(F.array(x["key"]), F.array(x["value"]))))
    clash = F.size(F.array_distinct(F.transform("entries", lambda x: x["key"]))) < F.size("entries")
    fields = F.when(clash, folded).otherwise(F.map_from_entries("entries"))
    return named.select("series", "file", "rec", F.coalesce(fields, F.create_map().cast("map<string, string>")).alias("fields"))


def cells(unified: DataFrame) -> DataFrame:
    """``unify``'s table with one row a value: ``field``, ``kind`` (null for JSON null) and ``value`` as plain text; a
    record without fields has one row of nulls."""
    one = unified.select("series", "file", "rec", F.explode_outer("fields").alias("field", "text"))
    text = F.when(_kind(F.col("text")) == 1, F.expr("variant_get(try_parse_json(text), '$', 'string')")).when(F.col("text") != "null", F.col("text"))
    kind = _names(_kind(F.col("text")))
    return one.select("series", "file", "rec", "field", F.when(F.length(kind) > 0, kind).alias("kind"), text.alias("value"))


def as_columns(unified: DataFrame, most: int = 5000) -> DataFrame:
    """``unify``'s table with one typed column a field: ``series``, ``file``, ``rec`` and the fields by name.

    Fields of different series whose names differ only in spelling (case, separators, outer blanks, version endings)
    share a column, unless one series has both. A column whose values are all numbers is double, all booleans boolean,
    else text; arrays and objects are JSON text. Names that clash without case get ``_2``, ``_3``, .... The driver gets
    the distinct field names; more than ``most`` columns are an error.
    """
    seen = unified.select("series", F.explode("fields").alias("field", "text")).groupBy("series", "field").agg(F.bit_or(_kind(F.col("text"))).alias("kinds"))
    held = cut(seen.withColumn("plain", _plain_column(F.col("field"))))
    shared = held.groupBy("series", "plain").agg(F.count("*").alias("of"))
    named = held.join(shared, ["series", "plain"]).withColumn("column", F.when((F.col("of") == 1) & (F.col("plain") != ""), F.col("plain")).otherwise(F.col("field")))
    columns = named.groupBy("column").agg(F.bit_or("kinds").alias("kinds"), F.collect_set("field").alias("fields")).limit(most + 1).collect()
    if len(columns) > most:
        raise RuleError(f"the records have more than {most} fields")
    taken: dict[str, int] = {"series": 1, "file": 1, "rec": 1}
    out: list[Column] = []
    for r in sorted(columns, key=lambda r: r["column"]):
        low = r["column"].lower()
        taken[low] = n = taken.get(low, 0) + 1
        name = r["column"] if n == 1 else f"{r['column']}_{n}"
        raw = F.coalesce(*[F.try_element_at("fields", F.lit(f)) for f in sorted(r["fields"])])
        text = F.when(_kind(raw) == 1, F.variant_get(F.try_parse_json(raw), "$", "string")).when(raw != "null", raw)
        out.append((text.try_cast("double") if r["kinds"] == 2 else text.try_cast("boolean") if r["kinds"] == 4 else text).alias(name))
    return unified.select("series", "file", "rec", *out)
