"""Rule expressions compiled to Catalyst columns: a checked subset of Python's expression grammar, nothing is evaluated."""

from __future__ import annotations

import ast
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ruleframe.errors import RuleError
from ruleframe.functions.columns import blank, is_text, kind, q

Typed = tuple[Column, str]  # kinds: int, float, bool, str, date

_RANK = {"bool": 0, "int": 1, "float": 2}


def _num(x: Typed) -> Typed:
    c, k = x
    if k in ("str", "date"):
        raise RuleError("a text or date stands where a number is needed")
    return (c.cast("long"), "int") if k == "bool" else x


def _common(xs: list[Typed]) -> tuple[list[Column], str]:
    kinds = {k for _, k in xs}
    if kinds in ({"str"}, {"date"}):
        return [c for c, _ in xs], kinds.pop()
    if kinds & {"str", "date"}:
        raise RuleError("numbers, texts and dates are mixed")
    top = max(kinds, key=_RANK.__getitem__)
    cast = {"float": "double", "int": "long", "bool": "boolean"}[top]
    return [c.cast(cast) for c, _ in xs], top


def _truth(x: Typed) -> Column:
    c, k = x
    return c if k == "bool" else (c != "" if k == "str" else c != 0)


class _Compiler(ast.NodeVisitor):
    def __init__(self, df: DataFrame) -> None:
        self.df = df

    def generic_visit(self, node: ast.AST) -> Typed:
        raise RuleError(f"{type(node).__name__} is not allowed in an expression")

    def visit_Expression(self, node: ast.Expression) -> Typed:
        return self.visit(node.body)

    def visit_Constant(self, node: ast.Constant) -> Typed:
        v = node.value
        if isinstance(v, bool):
            return F.lit(v), "bool"
        if isinstance(v, int):
            return F.lit(v).cast("long"), "int"
        if isinstance(v, float):
            return F.lit(v), "float"
        if isinstance(v, str):
            return F.lit(v), "str"
        raise RuleError(f"the constant {v!r} is not allowed")

    def visit_Name(self, node: ast.Name) -> Typed:
        if node.id == "__UUID__":
            return F.regexp_replace(F.uuid(), "-", ""), "str"
        if node.id not in self.df.columns:
            raise RuleError(f"unknown name {node.id}")
        return column(self.df, node.id)

    def visit_UnaryOp(self, node: ast.UnaryOp) -> Typed:
        x = self.visit(node.operand)
        if isinstance(node.op, ast.Not):
            return ~_truth(x), "bool"
        c, k = _num(x)
        if isinstance(node.op, ast.USub):
            return F.lit(0).cast("double" if k == "float" else "long") - c, k
        if isinstance(node.op, ast.UAdd):
            return c, k
        raise RuleError("this operator is not allowed")

    def visit_BinOp(self, node: ast.BinOp) -> Typed:
        a, b = self.visit(node.left), self.visit(node.right)
        if isinstance(node.op, ast.Add) and a[1] == b[1] == "str":
            return F.concat(a[0], b[0]), "str"
        if isinstance(node.op, ast.Mult) and {a[1], b[1]} <= {"str", "int"} and "str" in (a[1], b[1]):
            s, n = (a, b) if a[1] == "str" else (b, a)
            return F.repeat(s[0], n[0].cast("int")), "str"
        (x, y), k = _common([_num(a), _num(b)])
        match node.op:
            case ast.Add():
                return x + y, k
            case ast.Sub():
                return x - y, k
            case ast.Mult():
                return x * y, k
            case ast.Div():
                return x.cast("double") / y.cast("double"), "float"
            case ast.FloorDiv():
                return F.floor(x.cast("double") / y.cast("double")).cast("double" if k == "float" else "long"), k
            case ast.Mod():  # the sign follows the divisor
                rest = x % y
                return F.when((rest != 0) & ((rest < 0) != (y < 0)), rest + y).otherwise(rest), k
            case ast.Pow():
                return F.pow(x.cast("double"), y.cast("double")), "float"
        raise RuleError("this operator is not allowed")

    def visit_BoolOp(self, node: ast.BoolOp) -> Typed:
        xs = [self.visit(v) for v in node.values]
        values, k = _common(xs)
        out = values[-1]
        for v, x in zip(reversed(values[:-1]), reversed(xs[:-1])):  # operands come back, as in Python
            out = F.when(_truth(x), out).otherwise(v) if isinstance(node.op, ast.And) else F.when(_truth(x), v).otherwise(out)
        return out, k

    def visit_Compare(self, node: ast.Compare) -> Typed:
        tests: list[Column] = []
        left = self.visit(node.left)
        for op, right_node in zip(node.ops, node.comparators):
            if isinstance(op, (ast.In, ast.NotIn)):
                if isinstance(right_node, (ast.List, ast.Tuple, ast.Set)):
                    inside = F.lit(False)
                    for e in right_node.elts:
                        (x, y), _ = _common([left, self.visit(e)])
                        inside = inside | (x == y)
                else:
                    part = self.visit(right_node)
                    if left[1] != "str" or part[1] != "str":
                        raise RuleError("in needs texts or a list")
                    inside = part[0].contains(left[0])
                tests.append(~inside if isinstance(op, ast.NotIn) else inside)
                continue
            right = self.visit(right_node)
            if (left[1] == "str") != (right[1] == "str") and isinstance(op, (ast.Eq, ast.NotEq)):
                tests.append(F.lit(isinstance(op, ast.NotEq)))
            else:
                (x, y), _ = _common([left, right])
                ops: dict[type, Callable[[], Column]] = {ast.Eq: lambda: x == y, ast.NotEq: lambda: x != y, ast.Lt: lambda: x < y, ast.LtE: lambda: x <= y, ast.Gt: lambda: x > y, ast.GtE: lambda: x >= y}
                if type(op) not in ops:
                    raise RuleError("this comparison is not allowed")
                tests.append(ops[type(op)]())
            left = right
        out = tests[0]
        for t in tests[1:]:
            out = out & t
        return out, "bool"

    def visit_IfExp(self, node: ast.IfExp) -> Typed:
        (a, b), k = _common([self.visit(node.body), self.visit(node.orelse)])
        return F.when(_truth(self.visit(node.test)), a).otherwise(b), k

    def visit_Subscript(self, node: ast.Subscript) -> Typed:
        c, k = self.visit(node.value)
        if k != "str":
            raise RuleError("only texts can be sliced")
        bound = lambda n: None if n is None else self._int(n)
        size = F.length(c)
        place = lambda i: F.lit(i) if i >= 0 else F.greatest(size + i, F.lit(0))
        if isinstance(node.slice, ast.Slice):
            if node.slice.step is not None:
                raise RuleError("slices have no step")
            low, high = bound(node.slice.lower), bound(node.slice.upper)
            a = F.lit(0) if low is None else place(low)
            b = size if high is None else F.least(place(high), size)
            return F.substr(c, a + 1, F.greatest(b - a, F.lit(0))), "str"
        i = self._int(node.slice)
        at = F.lit(i) if i >= 0 else size + i
        return F.when((at < 0) | (at >= size), F.raise_error(F.lit("text index out of range")).cast("string")).otherwise(F.substr(c, at + 1, F.lit(1))), "str"

    @staticmethod
    def _int(node: ast.AST) -> int:
        v = ast.literal_eval(node)
        if isinstance(v, bool) or not isinstance(v, int):
            raise RuleError("slice bounds are whole numbers")
        return v

    def visit_Attribute(self, node: ast.Attribute) -> Typed:
        c, k = self.visit(node.value)
        if k != "date" or node.attr not in ("year", "month", "day", "hour", "minute", "second"):
            raise RuleError(f"the attribute {node.attr} is not allowed")
        return getattr(F, {"day": "dayofmonth"}.get(node.attr, node.attr))(c).cast("long"), "int"

    def _date_call(self, node: ast.Call) -> Typed:
        """``arrow.get(text[, pattern])``, ``.shift(months=1, ...)``, ``.format(pattern)``."""
        name = node.func.attr
        if isinstance(node.func.value, ast.Name) and node.func.value.id == "arrow":
            if name != "get" or len(node.args) not in (1, 2) or node.keywords:
                raise RuleError("of arrow only get(text[, pattern]) is known")
            c, k = self.visit(node.args[0])
            text = c if k == "str" else c.cast("string")
            if len(node.args) == 1:
                return (c, "date") if k == "date" else (text.cast("timestamp_ntz"), "date")
            return F.to_timestamp_ntz(text, F.lit(_java_date(self._text(node.args[1])))), "date"
        c, k = self.visit(node.func.value)
        if k != "date":
            raise RuleError(f"the call of {name} is not allowed")
        if name == "format":
            pattern = self._text(node.args[0]) if node.args else "YYYY-MM-DD HH:mm:ssZZ"
            return F.date_format(c, _java_date(pattern)), "str"
        if name == "shift" and not node.args:
            for part in node.keywords:
                if part.arg not in ("years", "quarters", "months", "weeks", "days", "hours", "minutes", "seconds"):
                    raise RuleError(f"a date cannot be shifted by {part.arg}")
                n = _num(self.visit(part.value))[0].cast("int")
                n, unit = (n * 3, "months") if part.arg == "quarters" else (n, {"minutes": "mins", "seconds": "secs"}.get(part.arg, part.arg))
                c = c + F.make_interval(**{unit: n})
            return c.cast("timestamp_ntz"), "date"
        raise RuleError(f"the call of {name} is not allowed")

    @staticmethod
    def _text(node: ast.AST) -> str:
        v = ast.literal_eval(node)
        if not isinstance(v, str):
            raise RuleError("a pattern is a text")
        return v

    def visit_Call(self, node: ast.Call) -> Typed:
        if isinstance(node.func, ast.Attribute):
            return self._date_call(node)
        if not isinstance(node.func, ast.Name) or node.keywords:
            raise RuleError("only the listed functions can be called")
        args = [self.visit(a) for a in node.args] if not (node.args and isinstance(node.args[0], (ast.List, ast.Tuple))) else [self.visit(a) for a in node.args[0].elts]
        name = node.func.id
        if name in ("max", "min", "sum") and args:
            xs, k = _common(args if name != "sum" else [_num(a) for a in args])
            if name == "sum":
                total = xs[0]
                for x in xs[1:]:
                    total = total + x
                return total, k
            return (xs[0] if len(xs) == 1 else F.greatest(*xs) if name == "max" else F.least(*xs)), k
        if name == "round" and len(args) in (1, 2):
            c, k = _num(args[0])
            digits = self._int(node.args[1]) if len(args) == 2 else 0
            half_even = F.bround(c, digits)
            return (half_even.cast("long"), "int") if len(args) == 1 or k == "int" else (half_even, "float")
        if len(args) != 1:
            raise RuleError(f"{name} takes one argument")
        c, k = args[0]
        match name:
            case "len" if k == "str":
                return F.length(c).cast("long"), "int"
            case "str":
                return c.cast("string"), "str"
            case "int":
                return (F.trim(c).cast("long") if k == "str" else c.cast("long")), "int"
            case "float":
                return (F.trim(c) if k == "str" else c).cast("double"), "float"
            case "abs":
                x, n = _num((c, k))
                return F.abs(x), n
        raise RuleError(f"the function {name} is not allowed")


def _java_date(pattern: str) -> str:
    """A date pattern of the expression language in the JVM's letters."""
    for theirs, ours in (("YYYY", "yyyy"), ("YY", "yy"), ("DD", "dd"), ("D", "d"), ("ZZ", "'+00:00'"), ("A", "a")):
        pattern = pattern.replace(theirs, ours)
    return pattern


def column(df: DataFrame, name: str) -> Typed:
    """A column as an operand; null and blank are 0, in texts "0"."""
    t = kind(df, name)
    if is_text(df, name):
        return F.when(blank(q(name)), F.lit("0")).otherwise(q(name)), "str"
    if isinstance(t, T.BooleanType):
        return F.coalesce(q(name), F.lit(False)), "bool"
    if isinstance(t, T.IntegralType):
        return F.coalesce(q(name).cast("long"), F.lit(0).cast("long")), "int"
    if isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)):
        return F.coalesce(q(name).cast("double"), F.lit(0.0)), "float"
    if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return q(name).cast("timestamp_ntz"), "date"
    return F.coalesce(q(name).cast("string"), F.lit("0")), "str"


def names_in(text: str) -> set[str]:
    """The names an expression uses; none if it cannot be read."""
    try:
        return {n.id for n in ast.walk(ast.parse(text.strip(), mode="eval")) if isinstance(n, ast.Name)}
    except SyntaxError:
        return set()


def compile_expression(df: DataFrame, text: str) -> Typed:
    try:
        tree = ast.parse(text.strip(), mode="eval")
    except SyntaxError as e:
        raise RuleError(f"the expression {text!r} cannot be read: {e.msg}") from e
    used = {n.id for n in ast.walk(tree) if isinstance(n, ast.Name)}
    if used & {"NA", "nan", "pd", "np"}:
        raise RuleError("expressions may not use NA, nan, pd or np")
    return _Compiler(df).visit(tree)
