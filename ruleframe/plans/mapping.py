"""Prioritised multi-condition mapping: rules to layered outputs with a trace.

Rules are matched against the distinct combinations of the condition columns, not against rows. Equality conditions are
join keys; a pattern is tested against the distinct values of its own column, and what it matches is a join key again.
Rules of one key are one row with all their codes.

The batches of a table run one after the other over the distinct combinations of the condition columns, and of these,
values that no rule can tell apart are one: a value that no rule names counts as the longest pattern ``^...`` it begins
with (``_kinds_of_rows``). What the batches find is written once a batch, without traces; these are made at the end, for
the combinations and the batch whose trace is shown. The rows themselves are read once for the combinations and once for
the result, however many batches there are. Values computed from the rows' own columns wait for the result, if no later
rule reads them. Where they cannot wait (``_waiting``), or rules read traces, the rows go through the batches, written
once a batch with their traces.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field
from functools import reduce
from itertools import chain
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ruleframe.errors import RuleError
from ruleframe.functions.columns import kind, q
from ruleframe.operators.sizes import BROADCAST_ROWS
from ruleframe.operators.unify import supertype, union_relaxed
from ruleframe.plans.expressions import compile_expression, names_in
from ruleframe.storage import cut

#: Rule tables shape the plan and are held by the driver.
MOST_RULES = 200_000
#: Found kinds of rows with traces of at most so many bytes are broadcast; larger ones are joined by exchange.
BROADCAST_BYTES = 32 << 20
#: Beginnings of at most so many lengths are looked up a row; columns with more keep all their values apart.
MOST_LENGTHS = 16
KEEP, KEEP_YES = "keep_row", "是"
#: A pattern that asks for a beginning only.
_HEAD = re.compile(r"\^([^\\^$.|?*+()\[\]{}]*)")
_PATTERN, _VARIABLE, _EXPRESSION = re.compile(r"reg\{(.*)\}", re.S), re.compile(r"var\{([^{}]*)\}(?:->reg\{(.*)\})?", re.S), re.compile(r"exp\{(.*)\}", re.S)
# The headers under which wide rule tables name a rule's conditions, its priority and its code.
_WIDE = {"映射规则类型": "rule_dimension", "映射优先顺序": "priority", "映射规则编码": "mapping_code"}


@dataclass(frozen=True, slots=True)
class Rule:
    order: float
    priority: float
    code: str
    ordinal: int
    conditions: dict[str, str]
    outputs: dict[str, Any] = field(default_factory=dict)

    @property
    def type(self) -> tuple[str, ...]:
        return tuple(self.conditions)


def _cell(v: Any) -> Any:
    return None if v is None or v == "" or (isinstance(v, float) and v != v) else v


def read_rules(rows: DataFrame | list[dict[str, Any]]) -> dict[float, list[Rule]]:
    """The rules of a single mapping table, by ``order_execution``; see the layout rules in the messages."""
    names: set[str] = set()
    if limited := isinstance(rows, DataFrame):  # row by row: the driver holds the rules only
        rows = (r.asDict() for r in rows.limit(MOST_RULES + 1).toLocalIterator())
        names |= (first := next(rows, {})).keys()
        rows = chain([first], rows)
    else:
        for r in rows:
            names |= r.keys()
    missing = [c for c in ("order_execution", "priority", "mapping_code", KEEP) if c not in names]
    if missing:
        raise RuleError(f"the mapping table lacks {missing}")
    numbers = sorted({m.group(1) for n in names if (m := re.fullmatch(r"(?:source|output)_field_(\w+)", n))}, key=lambda x: (len(x), x))
    out: dict[float, list[Rule]] = defaultdict(list)
    codes: set[str] = set()
    same: dict[str, str] = {}  # of equal texts one is kept
    text = lambda v: same.setdefault(v, v)
    for i, r in enumerate(rows):
        if i == MOST_RULES and limited:
            raise RuleError(f"a rule table has at most {MOST_RULES} rows")
        where = f"rule row {i + 1}"
        r = {k: _cell(r.get(k)) for k in names}
        order, priority, code = r["order_execution"], r["priority"], r["mapping_code"]
        if any(isinstance(x, bool) or not isinstance(x, (int, float)) for x in (order, priority)):
            raise RuleError(f"{where}: order_execution and priority must be numbers")
        if code is None or code in codes:
            raise RuleError(f"{where}: mapping_code must be given and unique")
        codes.add(code)
        conditions, outputs = {}, {KEEP: text(v) if isinstance(v := r[KEEP], str) else v}
        for n in numbers:
            f, v = r.get(f"source_field_{n}"), r.get(f"source_code_{n}")
            if f is None and v is not None:
                raise RuleError(f"{where}: source_code_{n} has no field")
            if f is not None:
                if v is None:
                    raise RuleError(f"{where}: the condition on {f} has no value")
                conditions[text(str(f))] = text(str(v))
            o = r.get(f"output_field_{n}")
            if o is not None:
                outputs[text(str(o))] = text(v) if isinstance(v := r.get(f"output_code_{n}"), str) else v
        out[order].append(Rule(order, priority, str(code), i, conditions, outputs))
    for order, rules in out.items():
        _validate(order, rules)
    return dict(sorted(out.items()))


def read_wide_rules(rows: DataFrame | list[dict[str, Any]], outputs: list[str]) -> list[Rule]:
    """The rules of a wide table: ``rule_dimension`` names the condition columns as ``A+B`` (blank: no condition), which
    hold the values; ``priority``, ``mapping_code`` and the ``outputs`` columns, under these or their Chinese headers."""
    if isinstance(rows, DataFrame):
        rows = [r.asDict() for r in rows.limit(MOST_RULES + 1).collect()]
    if len(rows) > MOST_RULES:
        raise RuleError(f"a rule table has at most {MOST_RULES} rows")
    out = []
    for i, given in enumerate(rows):
        r = {_WIDE.get(k, k): _cell(v) for k, v in given.items()}
        lacking = [c for c in ("priority", "mapping_code", *outputs) if c not in r]
        if lacking:
            raise RuleError(f"the rule table lacks {lacking}")
        if isinstance(r["priority"], bool) or not isinstance(r["priority"], (int, float)):
            raise RuleError(f"rule row {i + 1}: priority must be a number")
        names = [n.strip() for n in str(r.get("rule_dimension") or "").split("+") if n.strip()]
        absent = [n for n in names if n not in r]
        if absent:
            raise RuleError(f"rule row {i + 1}: the table has no columns {absent}")
        out.append(Rule(1.0, r["priority"], str(r["mapping_code"]), i, {n: "" if r[n] is None else str(r[n]) for n in names}, {o: r[o] for o in outputs}))
    _values_checked(out)
    return out


def _values_checked(rules: list[Rule]) -> None:
    """Outputs that speak of ``exp{`` or ``var{`` must be such a value as a whole."""
    for r in rules:
        for v in r.outputs.values():
            s = "" if v is None else str(v).strip()
            if "exp{" in s and not _EXPRESSION.fullmatch(s):
                raise RuleError(f"rule {r.code}: malformed expression {v!r}")
            if "exp{" not in s and "var{" in s and not ((m := _VARIABLE.fullmatch(s)) and (m.group(2) is not None or "reg{" not in s)):
                raise RuleError(f"rule {r.code}: malformed variable {v!r}")


def _validate(order: float, rules: list[Rule]) -> None:
    types: dict[float, set[tuple[str, ...]]] = defaultdict(set)
    for r in rules:
        types[r.priority].add(r.type)
        for v in r.outputs.values():
            m = _EXPRESSION.fullmatch(str(v).strip()) if v is not None else None
            if m and re.search(r"\b(NA|nan|pd|np)\b", m.group(1)):
                raise RuleError(f"rule {r.code}: expressions may not use NA, nan, pd or np")
    for priority, seen in types.items():
        if len(seen) > 1:
            raise RuleError(f"order {order}, priority {priority}: rules of different condition fields {sorted(seen)}")
    _values_checked(rules)
    repeated = [k for k, n in Counter((r.priority, tuple(r.conditions.items())) for r in rules if r.conditions).items() if n > 1]
    if repeated:
        raise RuleError(f"order {order}: repeated conditions {repeated[:3]}")
    if len({frozenset(r.outputs) for r in rules}) > 1:
        raise RuleError(f"order {order}: rules have different output fields")


def java_pattern(pattern: str) -> str:
    """A search pattern for the JVM; what it cannot express is refused."""
    if re.search(r"\(\?P[=>]|\(\?\(", pattern):
        raise RuleError(f"the pattern {pattern!r} is not supported")
    return pattern.replace("(?P<", "(?<").replace(r"\Z", r"\z")


def _head(pattern: str) -> str | None:
    """The text a value must begin with, if that is all a pattern asks for."""
    return "" if pattern == "" else m.group(1) if (m := _HEAD.fullmatch(pattern)) else None


def _well_formed(r: Rule) -> bool:
    return all("reg{" not in v or _PATTERN.fullmatch(v.strip()) for v in r.conditions.values())


def _pattern(v: str) -> str | None:
    return _PATTERN.fullmatch(v.strip()).group(1) if "reg{" in v else None


def _text(name: str) -> Column:
    return F.coalesce(q(name).cast("string"), F.lit(""))


def _sent(table: DataFrame, rows: list) -> DataFrame:
    return F.broadcast(table) if len(rows) <= BROADCAST_ROWS else table


def _matches(values: DataFrame, patterns: list[str], k: int) -> DataFrame:
    """The distinct ``values`` (``__v<k>``) with each pattern (``__p<k>``) found in them; ``^...`` by equal beginnings."""
    spark, v = values.sparkSession, F.col(f"__v{k}")
    heads = [(h, p) for p in patterns if (h := _head(p)) is not None]
    others = [(java_pattern(p),) for p in patterns if _head(p) is None]
    parts = []
    if heads:
        begins = F.array_distinct(F.array(*[F.substring(v, 1, n) for n in sorted({len(h) for h, _ in heads})]))
        table = _sent(spark.createDataFrame(heads, f"__h string, __p{k} string"), heads)
        parts.append(values.select(v, F.explode(begins).alias("__h")).join(table, "__h").drop("__h"))
    if others:
        parts.append(values.join(F.broadcast(spark.createDataFrame(others, f"__p{k} string")), F.rlike(v, F.col(f"__p{k}"))))
    return reduce(DataFrame.unionByName, parts)


def _hits(combos: DataFrame, rules: list[Rule], fields: list[str], trace: bool) -> DataFrame:
    """Each combination with each key of rules it satisfies: place (``__n<k>``) and value (``__o<k>``) of the last rule that
    gives a field, and all codes with their places; one join for each set of condition fields and of patterns in it."""
    spark = combos.sparkSession
    dims = combos.columns
    kinds: dict[tuple, dict[tuple, list[tuple[int, Rule]]]] = defaultdict(lambda: defaultdict(list))
    first_free = next((r for r in rules if not r.conditions), None)  # of the rules without conditions only the first counts
    for n, r in enumerate(sorted(rules, key=lambda r: (r.priority, r.ordinal))):
        if _well_formed(r) and (r.conditions or r is first_free):
            shape = tuple("reg{" in v for v in r.conditions.values())
            key = tuple(v if (p := _pattern(v)) is None else p if _head(p) is not None else java_pattern(p) for v in r.conditions.values())
            kinds[r.type, shape][key].append((n, r))
    found = [c for k in range(len(fields)) for c in (f"__n{k}", f"__o{k}")] + (["__codes"] if trace else [])
    types = [t for k in range(len(fields)) for t in (f"__n{k} int", f"__o{k} string")] + (["__codes array<struct<n: int, code: string>>"] if trace else [])
    parts = []
    for (names, shape), by_key in kinds.items():
        rows = []
        for key, some in by_key.items():
            last = [max(((n, str(v)) for n, r in some if (v := r.outputs.get(f)) is not None), default=(None, None)) for f in fields]
            rows.append((*key, *[x for pair in last for x in pair], *([[(n, r.code) for n, r in some]] if trace else [])))
        table = _sent(spark.createDataFrame(rows, ", ".join([*[f"__c{k} string" for k in range(len(names))], *types])), rows)
        met, tests = combos, []
        for k, (n, s) in enumerate(zip(names, shape)):
            if s:
                # the few distinct patterns against the distinct values of their column
                met = met.join(_matches(combos.select(_text(n).alias(f"__v{k}")).distinct(), sorted({r[k] for r in rows}), k), _text(n) == F.col(f"__v{k}"))
            tests.append((F.col(f"__p{k}") if s else _text(n)) == F.col(f"__c{k}"))
        met = met.join(table, reduce(lambda a, b: a & b, tests, F.lit(True)))
        parts.append(met.select(*[q(d) for d in dims], *found))
    if not parts:  # malformed patterns match nothing
        return combos.limit(0).select(*[q(d) for d in dims], *[F.lit(None).cast(t.split(" ", 1)[1]).alias(t.split(" ", 1)[0]) for t in types])
    return reduce(DataFrame.unionByName, parts)


def _resolve(df: DataFrame, raw: Column, values: list[str]) -> Column:
    """The value of an output: literals as they are, ``var{}``, ``var{}->reg{}`` and ``exp{}`` compiled."""
    made: list[tuple[str, Column, str]] = []
    plain = False
    for v in values:
        s = v.strip()
        if m := _VARIABLE.fullmatch(s):
            name, pattern = m.groups()
            if name not in df.columns:
                raise RuleError(f"{v}: the input has no column {name}")
            if pattern is None:
                made.append((v, q(name), kind(df, name).simpleString()))
            else:
                p, t = java_pattern(pattern), F.coalesce(q(name).cast("string"), F.lit(""))
                hit = F.when(t.rlike(p), F.regexp_extract(t, p, 1)).otherwise(F.raise_error(F.concat(F.lit(f"{v} finds nothing in "), t)).cast("string"))
                made.append((v, hit, "string"))
        elif m := _EXPRESSION.fullmatch(s):
            c, k = compile_expression(df, m.group(1))
            made.append((v, c, {"int": "bigint", "float": "double", "bool": "boolean", "str": "string", "date": "timestamp_ntz"}[k]))
        else:
            plain = True
    if not made:
        return raw
    kinds = {k for *_, k in made} | ({"string"} if plain else set())
    goal = kinds.pop() if len(kinds) == 1 else "double" if kinds <= {"int", "bigint", "double", "float"} else "string"
    out = F.when(F.lit(False), F.lit(None).cast(goal))
    for v, c, _ in made:
        out = out.when(raw == v, c.cast(goal))
    return out.otherwise(raw) if plain else out


def _met(df: DataFrame, rules: list[Rule], fields: list[str], trace: bool = True) -> DataFrame:
    """``df`` with ``__raw<k>`` for each field, ``__hit`` (true or null) and, if asked for, ``__trace``."""
    dims = list(dict.fromkeys(c for r in rules for c in r.conditions))
    missing = [d for d in dims if d not in df.columns]
    if missing:
        raise RuleError(f"the input lacks the condition columns {missing}")
    combos = df.select(*[q(d) for d in dims]).distinct() if dims else df.sparkSession.range(1).select(F.lit(1).alias("__one"))
    hits = _hits(combos, rules, fields, trace)
    best = [F.max_by(f"__o{k}", f"__n{k}").alias(f"__raw{k}") for k in range(len(fields))]
    codes = [F.array_join(F.transform(F.sort_array(F.flatten(F.collect_list("__codes"))), lambda x: x["code"]), "->").alias("__trace")] if trace else []
    picked = hits.groupBy(*[q(d) for d in dims]).agg(*best, *codes, F.lit(True).alias("__hit"))
    if not dims:
        return df.join(F.broadcast(picked), F.lit(True), "left")
    picked = picked.withColumnsRenamed({d: f"__d{k}" for k, d in enumerate(dims)})
    same = reduce(lambda a, b: a & b, [q(d).eqNullSafe(F.col(f"__d{k}")) for k, d in enumerate(dims)])
    return df.join(picked, same, "left").drop(*[f"__d{k}" for k in range(len(dims))])


def _given(rules: list[Rule], f: str) -> list[str]:
    return sorted({str(r.outputs[f]) for r in rules if r.outputs.get(f) is not None})


def _fields(rules: list[Rule]) -> list[str]:
    return list(dict.fromkeys(f for r in rules for f in r.outputs))


def map_batch(df: DataFrame, rules: list[Rule], sequential: bool = False) -> DataFrame:
    """``df`` with ``__out_<field>`` for each output field and ``__trace``: the codes of all rules hit, by priority.

    Each field takes the last non-null value by priority; equal priorities go by rule row. No hit: all null. Computed
    values see the columns of ``df``; ``sequential`` lets a later field see the results of earlier ones under their names.
    """
    fields = _fields(rules)
    met = _met(df, rules, fields).drop("__hit")
    hidden = {}
    for k, f in enumerate(fields):
        made = _resolve(met if sequential else df, F.col(f"__raw{k}"), _given(rules, f))
        met = met.withColumn(f"__out_{f}", made)
        if sequential:
            if f in met.columns:
                hidden[f] = f"__in_{k}"
                met = met.withColumnRenamed(f, hidden[f])
            met = met.withColumn(f, q(f"__out_{f}"))
    if sequential:
        met = met.drop(*fields).withColumnsRenamed({v: k for k, v in hidden.items()})
        return met.select(*[q(c) for c in df.columns], *[q(f"__out_{f}") for f in fields], "__trace")
    return met.drop(*[f"__raw{k}" for k in range(len(fields))])


def map_n(df: DataFrame, rows: DataFrame | list[dict[str, Any]], outputs: list[str], miss_ok: bool = True, drop_if_exists: bool = True) -> DataFrame:
    """One batch of wide rules as a library call: ``df`` with the ``outputs`` and ``map_trc_<output>``, null where no rule
    is hit. Computed values see earlier outputs. Columns of these names are replaced, or refused."""
    new = [*outputs, *[f"map_trc_{o}" for o in outputs]]
    there = [c for c in new if c in df.columns]
    if there and not drop_if_exists:
        raise RuleError(f"the input already has {there}")
    df = df.drop(*there)
    met = map_batch(df, read_wide_rules(rows, outputs), sequential=True)
    if not miss_ok and (n := met.where("__trace is null").count()):
        raise RuleError(f"{n} rows are hit by no rule")
    return met.select(*[q(c) for c in df.columns], *[q(f"__out_{o}").alias(o) for o in outputs], *[F.col("__trace").alias(f"map_trc_{o}") for o in outputs])


@dataclass(frozen=True)
class Mapped:
    result: DataFrame
    missed: DataFrame
    """Rows a batch had no rule for, as they entered it, with ``miss_order_execution``; they go no further."""


def _reads(rules: list[Rule], field: str) -> tuple[set[str], list[tuple[str, str]], bool]:
    """The names that computed values of a field read; its ``var{}->reg{}``; whether it has an ``exp{}``."""
    names, searched, computed = set(), [], False
    for v in map(str.strip, _given(rules, field)):
        if m := _VARIABLE.fullmatch(v):
            names.add(m.group(1))
            searched += [(m.group(1), m.group(2))] if m.group(2) is not None else []
        elif m := _EXPRESSION.fullmatch(v):
            names |= names_in(m.group(1))
            computed = True
    return names, searched, computed


def _waiting(df: DataFrame, batches: list[list[Rule]]) -> tuple[set[tuple[int, str]], set[str]] | None:
    """The fields a batch whose computed values can wait for the result, and the columns of ``df`` that others read.

    A value can wait if it reads columns as they were given and no later rule reads it, and if it cannot stop the query in
    a batch whose result is replaced: there, patterns are tried on all rows and expressions do not wait. None: the rows
    must go through the batches.
    """
    known = {c for rules in batches for r in rules for c in (*r.conditions, *r.outputs)}
    reads = [{f: _reads(rules, f) for f in _fields(rules)} for rules in batches]
    needed = [{c for r in rules for c in r.conditions} | {c for names, *_ in of.values() for c in names} for rules, of in zip(batches, reads)]
    written: set[str] = set()
    late, exact, tried = set(), set(), set()
    for n, rules in enumerate(batches):
        if needed[n] & {f"map_trc_{f}" for f in written}:
            return None
        after = set().union(*needed[n + 1 :])
        last = n == len(batches) - 1
        for f, (names, searched, computed) in reads[n].items():
            if not names:
                continue
            if f != KEEP and f not in after and not names & written and (last or not computed):
                late.add((n, f))
                tried |= set() if last else {x for x in searched if x[0] in df.columns}
            elif "__UUID__" in names or (names - known) & set(df.columns):
                return None
            else:
                exact |= (names - written) & set(df.columns)
        written |= set(reads[n])
    if tried:
        fails = [F.count_if(~_text(c).rlike(java_pattern(p))) for c, p in sorted(tried)]
        if any(df.agg(*fails).first()):
            return None
    return late, exact


def _kinds_of_rows(df: DataFrame, batches: list[list[Rule]], exact: set[str]) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with a column for each condition column and each of ``exact``, alike in rows that all rules treat alike.

    A value stays as it is where rules name it, or the combination of values it is in. Of the others rules see only which
    patterns they match; where all patterns are beginnings, the longest of these tells that. It stands for the value, with
    a character behind it that no rule contains.
    """
    spark = df.sparkSession
    equal: dict[tuple[str, ...], set[tuple[str, ...]]] = defaultdict(set)
    heads: dict[str, set[str]] = defaultdict(set)
    columns: list[str] = [c for c in df.columns if c in exact]
    exact, written = set(exact), set()
    for rules in batches:
        for r in rules:
            given = {c: v for c, v in sorted(r.conditions.items()) if c in df.columns and c not in written}
            columns += [c for c in given if c not in columns]
            if not _well_formed(r):
                continue
            patterns = {c: p for c, v in given.items() if (p := _pattern(v)) is not None}
            for c, p in patterns.items():
                (exact.add(c) if _head(p) is None else heads[c].add(_head(p)))
            if names := tuple(c for c in given if c not in patterns):
                equal[names].add(tuple(given[c] for c in names))
        written |= set(_fields(rules))
    exact |= {c for c, some in heads.items() if len({len(h) for h in some}) > MOST_LENGTHS}
    used = set("".join(v for rules in batches for r in rules for v in r.conditions.values()))
    mark = next(chr(x) for x in range(0xE000, 0x110000) if chr(x) not in used)
    at, named, best = df, defaultdict(list), defaultdict(list)
    for i, (names, keys) in enumerate(equal.items()):
        if set(names) <= exact:
            continue
        rows = [(*k, True) for k in sorted(keys)]
        table = _sent(spark.createDataFrame(rows, ", ".join([*[f"__e{j} string" for j in range(len(names))], f"__f{i} boolean"])), rows)
        at = at.join(table, reduce(lambda a, b: a & b, [_text(c) == F.col(f"__e{j}") for j, c in enumerate(names)]), "left").drop(*[f"__e{j}" for j in range(len(names))])
        for c in names:
            named[c].append(F.coalesce(F.col(f"__f{i}"), F.lit(False)))
    for i, c in enumerate(columns):
        for n in sorted({len(h) for h in heads[c]}, reverse=True) if c not in exact else ():
            rows = [(h,) for h in sorted(heads[c]) if len(h) == n]
            at = at.join(_sent(spark.createDataFrame(rows, f"__h{i}_{n} string"), rows), F.substring(_text(c), 1, n) == F.col(f"__h{i}_{n}"), "left")
            best[c].append(F.col(f"__h{i}_{n}"))
    keys = {c: f"__k{i}" for i, c in enumerate(columns)}
    kind_of = lambda c: F.when(reduce(lambda a, b: a | b, named[c], F.lit(False)), _text(c)).otherwise(F.concat(F.coalesce(*best[c], F.lit("")), F.lit(mark)))
    return at.select(*[q(c) for c in df.columns], *[(q(c) if c in exact else kind_of(c)).alias(k) for c, k in keys.items()]), keys


def _same(left: list[str], right: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right)], F.lit(True))


def _by_row(df: DataFrame, batches: dict[float, list[Rule]]) -> Mapped:
    work = df
    missed: list[DataFrame] = []
    for n, (order, rules) in enumerate(batches.items()):
        fields = _fields(rules)
        work = cut(work) if n else work
        met = map_batch(work, rules)
        missed.append(met.where("__trace is null").select(*[q(c) for c in work.columns], F.lit(float(order)).alias("miss_order_execution")))
        new = [*fields, *[f"map_trc_{f}" for f in fields]]
        work = met.where("__trace is not null").select(
            *[q(c) for c in work.columns if c not in new], *[q(f"__out_{f}").alias(f) for f in fields], *[F.col("__trace").alias(f"map_trc_{f}") for f in fields]
        )
        work = work.where(F.col(KEEP) == KEEP_YES)
    return Mapped(work, union_relaxed(missed))


def _by_kind(df: DataFrame, orders: list[float], batches: list[list[Rule]], late: set[tuple[int, str]], exact: set[str]) -> Mapped:
    rows, keys = _kinds_of_rows(df, batches, exact)
    ids = list(keys.values())
    work = cut(rows.select(*[F.col(k).alias(c) for c, k in keys.items()]).distinct()).withColumns({k: q(c) for c, k in keys.items()})
    entered: list[DataFrame] = []
    ends: list[tuple[DataFrame, dict[str, int]]] = []  # what a batch has no rule for, and at last what is kept; who wrote which field
    writers: dict[str, int] = {}
    for n, rules in enumerate(batches):
        fields = _fields(rules)
        work = cut(work) if n else work
        entered.append(work)
        met = _met(work, rules, fields, trace=False)
        ends.append((met.where("__hit is null").select(*[q(c) for c in work.columns]), dict(writers)))
        gone = {*fields, *[f"__late{writers[f]}_{f}" for f in fields if f in writers]}
        outs = [F.col(f"__raw{k}").alias(f"__late{n}_{f}") if (n, f) in late else _resolve(work, F.col(f"__raw{k}"), _given(rules, f)).alias(f) for k, f in enumerate(fields)]
        work = met.where("__hit").select(*[q(c) for c in work.columns if c not in gone], *outs).where(F.col(KEEP) == KEEP_YES)
        writers |= {f: n for f in fields}
    ends.append((work, writers))

    written = lambda of: [q(f"__late{n}_{f}" if (n, f) in late else f).alias(f"__w{n}_{f}") for f, n in of.items()]
    found = cut(union_relaxed([end.select(*ids, *written(of), F.lit(j).alias("__end")) for j, (end, of) in enumerate(ends)]))
    traced = sorted({n for _, of in ends for n in of.values()})
    others = [f"__t{i}" for i in range(len(ids))]
    renamed = [F.col(k).alias(t) for k, t in zip(ids, others)]
    wide = found
    for n in traced:
        here = found.where(F.col("__end").isin([j for j, (_, of) in enumerate(ends) if n in of.values()])).select(*renamed)
        codes = _met(entered[n].join(here, _same(ids, others), "left_semi"), batches[n], []).select(*renamed, F.col("__trace").alias(f"__trace{n}"))
        wide = wide.join(codes, _same(ids, others), "left").drop(*others)
    wide = cut(wide.withColumn("__kept", F.col("__end") == len(batches))).withColumnsRenamed({k: f"__j{i}" for i, k in enumerate(ids)})
    sizes = {r[0]: (r[1], sum(x or 0 for x in r[2:])) for r in wide.groupBy("__kept").agg(F.count("*"), *[F.sum(F.octet_length(f"__trace{n}")) for n in traced]).collect()}

    def spread(some: list[int], kept: bool) -> DataFrame:
        """The rows of the kinds that came to these of the ``ends``."""
        shown = {j: ends[j][1] for j in some}
        n, size = sizes.get(kept, (0, 0))
        part = wide.where(F.col("__kept") == kept)
        part = F.broadcast(part) if n <= BROADCAST_ROWS and size <= BROADCAST_BYTES else part
        joined = rows.join(part, _same(ids, [f"__j{i}" for i in range(len(ids))]))

        def shown_as(c: str) -> Column:
            """A column where it comes from in each of the frames, with a common type."""
            sources: dict[str, tuple[Column, list[int]]] = {}
            for j in some:
                if c in shown[j]:
                    n = shown[j][c]
                    s = (f"written {n}", _resolve(df, q(f"__w{n}_{c}"), _given(batches[n], c)) if (n, c) in late else q(f"__w{n}_{c}"))
                elif c.startswith("map_trc_") and c[8:] in shown[j]:
                    s = (f"trace {shown[j][c[8:]]}", F.col(f"__trace{shown[j][c[8:]]}"))
                else:
                    s = ("own", q(c)) if c in df.columns else ("none", F.lit(None))
                sources.setdefault(s[0], (s[1], []))[1].append(j)
            common = reduce(supertype, [kind(joined.select(s.alias("x")), "x") for s, _ in sources.values()])
            common = T.StringType() if isinstance(common, T.NullType) else common
            *firsts, (rest, _) = sources.values()
            if not firsts:
                return rest.cast(common).alias(c)
            return reduce(lambda a, s: a.when(F.col("__end").isin(s[1]), s[0].cast(common)), firsts, F).otherwise(rest.cast(common)).alias(c)

        fields = list(dict.fromkeys(f for of in shown.values() for f in of))
        new = [*fields, *[f"map_trc_{f}" for f in fields]]
        order = [] if kept else [reduce(lambda a, j: a.when(F.col("__end") == j, F.lit(float(orders[j]))), some, F).alias("miss_order_execution")]
        return joined.select(*[shown_as(c) for c in [*[c for c in df.columns if c not in new], *new]], *order)

    return Mapped(spread([len(batches)], True), spread(list(range(len(batches))), False))


def map_table(df: DataFrame, rows: DataFrame | list[dict[str, Any]]) -> Mapped:
    """All batches one after the other. Outputs replace columns of the same name, with nulls too; only rows whose
    ``keep_row`` came out as 是 go on. ``keep_row`` and ``map_trc_<field>`` stay in the result."""
    batches = read_rules(rows)
    if not batches:
        return Mapped(df, df.limit(0).withColumn("miss_order_execution", F.lit(0.0)))
    # one batch matches distinct combinations anyway
    waiting = _waiting(df, list(batches.values())) if len(batches) > 1 else None
    return _by_row(df, batches) if waiting is None else _by_kind(df, list(batches), list(batches.values()), *waiting)


def mapping_1t(df: DataFrame, rows: DataFrame | list[dict[str, Any]], miss_ok: bool = True) -> DataFrame:
    mapped = map_table(df, rows)
    if not miss_ok and (n := mapped.missed.count()):
        raise RuleError(f"{n} rows are hit by no rule")
    return mapped.result
