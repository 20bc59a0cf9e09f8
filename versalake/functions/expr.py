"""Filter expressions: a safe subset of Python's expressions, compiled into Spark columns.

    compile_expression("labels == 1 or 'cat' in tags and price // 2 > 3", schema)

Allowed: comparisons (chained, too), in / not in, and / or / not, + - * / // % **, unary signs, subscripts, attributes,
list and tuple literals, constants. Calls, lambdas, comprehensions, names with a leading underscore and everything
else are rejected before anything is built. The text never runs; it becomes a plan that Catalyst optimises.

Semantics are Python's where Spark's differ: `/` is true division, `//` floors, `%` has the divisor's sign, a division
by zero is null; `x == [..]` on an array compares as sets; `array == value` asks whether the array contains it. An
expression is true where its value is truthy; null is false, and `not null` is true.
"""

from __future__ import annotations

import ast
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from versalake.errors import ExpressionError, UnknownColumn

_COMPARE = {
    ast.Eq: lambda a, b: a == b,
    ast.NotEq: lambda a, b: a != b,
    ast.Lt: lambda a, b: a < b,
    ast.LtE: lambda a, b: a <= b,
    ast.Gt: lambda a, b: a > b,
    ast.GtE: lambda a, b: a >= b,
}
_REDUCTIONS = ("min", "max", "mean", "size", "shape")


class Value:
    """A column with its type and, for class labels, its names."""

    def __init__(self, column: Column | None, kind: T.DataType | None, literal=None, names: list[str] | None = None, parts: dict | None = None):
        self.column, self.kind, self.literal, self.names, self.parts = column, kind, literal, names, parts

    @property
    def is_literal(self) -> bool:
        return self.column is None and self.parts is None

    @property
    def is_array(self) -> bool:
        return isinstance(self.kind, T.ArrayType) or isinstance(self.literal, (list, tuple))

    def get(self) -> Column:
        if self.parts is not None:
            raise ExpressionError("a group isn't a value; name one of its columns")
        if self.column is not None:
            return self.column
        if isinstance(self.literal, (list, tuple)):
            return F.array(*(F.lit(v) for v in self.literal))
        return F.lit(self.literal)


def truth(value: Value) -> Column:
    """Python's truthiness; null is false."""
    if value.is_literal:
        return F.lit(bool(value.literal))
    c = value.get()
    if isinstance(value.kind, T.BooleanType):
        out = c
    elif isinstance(value.kind, T.ArrayType):
        out = F.size(c) > 0
    elif isinstance(value.kind, (T.StringType, T.BinaryType)):
        out = F.length(c) > 0
    elif isinstance(value.kind, T.NumericType):
        out = c != 0
    else:
        out = c.isNotNull()
    return F.coalesce(out, F.lit(False))


def true_divide(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def floor_divide(a: Column, b: Column) -> Column:
    return F.floor(true_divide(a, b))


def modulo(a: Column, b: Column) -> Column:
    return a - b * floor_divide(a, b)


_ARITHMETIC = {
    ast.Add: lambda a, b: a + b,
    ast.Sub: lambda a, b: a - b,
    ast.Mult: lambda a, b: a * b,
    ast.Div: true_divide,
    ast.FloorDiv: floor_divide,
    ast.Mod: modulo,
    ast.Pow: lambda a, b: F.power(a.cast("double"), b.cast("double")),
}


class _Compiler:
    def __init__(self, fields: dict[str, T.StructField], class_names: dict[str, list[str]]):
        self.fields, self.class_names, self.used = fields, class_names, []

    def name(self, path: str) -> Value:
        if path in self.fields:
            self.used.append(path)
            return Value(F.col(f"`{path}`"), self.fields[path].dataType, names=self.class_names.get(path))
        inside = {k: f for k, f in self.fields.items() if k.startswith((path + ".", path + "/"))}
        if inside:
            return Value(None, None, parts={"at": path})
        raise UnknownColumn(path)

    def visit(self, node: ast.AST) -> Value:
        method = getattr(self, "on_" + type(node).__name__.lower(), None)
        if method is None:
            raise ExpressionError(f"{type(node).__name__} isn't allowed in an expression")
        return method(node)

    def on_expression(self, node):
        return self.visit(node.body)

    def on_constant(self, node):
        if not isinstance(node.value, (bool, int, float, str, bytes, type(None))):
            raise ExpressionError(f"{node.value!r} isn't allowed in an expression")
        return Value(None, None, node.value)

    def on_name(self, node):
        if node.id.startswith("_"):
            raise ExpressionError(f"private name {node.id}")
        return self.name(node.id)

    def on_list(self, node):
        parts = [self.visit(e) for e in node.elts]
        if all(p.is_literal for p in parts):
            return Value(None, None, [p.literal for p in parts])
        return Value(F.array(*(p.get() for p in parts)), T.ArrayType(parts[0].kind or T.StringType()))

    on_tuple = on_list

    def on_attribute(self, node):
        if node.attr.startswith("_"):
            raise ExpressionError(f"private attribute {node.attr}")
        base = self.visit(node.value)
        if base.parts is not None:
            at = base.parts["at"]
            for sign in (".", "/"):
                try:
                    return self.name(f"{at}{sign}{node.attr}")
                except UnknownColumn:
                    continue
            raise UnknownColumn(f"{at}.{node.attr}")
        if base.is_literal:
            raise ExpressionError(f"a constant has no {node.attr}")
        if isinstance(base.kind, T.StructType) and node.attr in base.kind.fieldNames():
            return Value(base.column.getField(node.attr), base.kind[node.attr].dataType)
        if node.attr in _REDUCTIONS:
            return self._reduce(base, node.attr)
        if isinstance(base.kind, T.MapType):
            return Value(F.try_element_at(base.column, F.lit(node.attr)), base.kind.valueType)
        raise ExpressionError(f"no attribute {node.attr}")

    def _reduce(self, base: Value, what: str) -> Value:
        c, kind = base.column, base.kind
        if not isinstance(kind, T.ArrayType):
            out = {"size": F.lit(1), "shape": F.array().cast("array<int>")}.get(what, c.cast("double") if what == "mean" else c)
            return Value(out, {"size": T.IntegerType(), "shape": T.ArrayType(T.IntegerType()), "mean": T.DoubleType()}.get(what, kind))
        levels, inner, flat = [c], kind, c
        while isinstance(inner.elementType, T.ArrayType):
            flat, inner = F.flatten(flat), inner.elementType
            levels.append(F.try_element_at(levels[-1], F.lit(1)))
        if what == "shape":
            return Value(F.array(*(F.size(x) for x in levels)), T.ArrayType(T.IntegerType()))
        if what == "size":
            return Value(F.size(flat), T.IntegerType())
        if what in ("min", "max"):
            return Value(F.array_min(flat) if what == "min" else F.array_max(flat), inner.elementType)
        total = F.aggregate(flat, F.lit(0.0), lambda s, x: s + x.cast("double"))
        return Value(F.try_divide(total, F.size(flat).cast("double")), T.DoubleType())

    def on_subscript(self, node):
        base = self.visit(node.value)
        if isinstance(node.slice, ast.Slice):
            raise ExpressionError("slices aren't allowed in an expression")
        at = self.visit(node.slice)
        if base.is_literal:
            if not at.is_literal:
                raise ExpressionError("a constant list takes a constant index")
            try:
                return Value(None, None, base.literal[at.literal])
            except (IndexError, TypeError, KeyError) as error:
                raise ExpressionError(str(error)) from error
        if isinstance(base.kind, T.ArrayType):
            i = at.get()
            return Value(F.try_element_at(base.column, F.when(i >= 0, i + 1).otherwise(i).cast("int")), base.kind.elementType)
        if isinstance(base.kind, T.MapType):
            return Value(F.try_element_at(base.column, at.get()), base.kind.valueType)
        if isinstance(base.kind, T.StructType) and at.is_literal and at.literal in base.kind.fieldNames():
            return Value(base.column.getField(at.literal), base.kind[at.literal].dataType)
        if isinstance(base.kind, T.StringType):
            i = at.get()
            return Value(F.substring(base.column, F.when(i >= 0, i + 1).otherwise(i), F.lit(1)), T.StringType())
        if at.is_literal and at.literal in (0, -1):  # a scalar is an array of one
            return base
        raise ExpressionError("this column has no elements")

    def on_unaryop(self, node):
        value = self.visit(node.operand)
        if isinstance(node.op, ast.Not):
            return Value(None, None, not value.literal) if value.is_literal else Value(~truth(value), T.BooleanType())
        if not isinstance(node.op, (ast.USub, ast.UAdd)):
            raise ExpressionError(f"{type(node.op).__name__} isn't allowed in an expression")
        if value.is_literal:
            return Value(None, None, -value.literal if isinstance(node.op, ast.USub) else +value.literal)
        return Value(-value.get(), value.kind) if isinstance(node.op, ast.USub) else value

    def on_binop(self, node):
        if type(node.op) not in _ARITHMETIC:
            raise ExpressionError(f"{type(node.op).__name__} isn't allowed in an expression")
        a, b = self.visit(node.left), self.visit(node.right)
        strings = [isinstance(v.kind, T.StringType) or isinstance(v.literal, str) for v in (a, b)]
        if all(strings) and isinstance(node.op, ast.Add):
            return Value(F.concat(a.get(), b.get()), T.StringType())
        if any(strings):
            raise ExpressionError("arithmetic takes numbers")
        fractional = any(isinstance(v.kind, T.FractionalType) or isinstance(v.literal, float) for v in (a, b))
        kind = T.DoubleType() if fractional or isinstance(node.op, (ast.Div, ast.Pow)) else T.LongType()
        x, y = a.get(), b.get()
        return Value(_ARITHMETIC[type(node.op)](x.cast(kind), y.cast(kind)), kind)

    def on_boolop(self, node):
        parts = [truth(self.visit(v)) for v in node.values]
        return Value(reduce((lambda a, b: a & b) if isinstance(node.op, ast.And) else (lambda a, b: a | b), parts), T.BooleanType())

    def on_compare(self, node):
        left, out = self.visit(node.left), []
        for op, right in zip(node.ops, node.comparators):
            right = self.visit(right)
            out.append(self._compare(op, left, right))
            left = right
        return Value(reduce(lambda a, b: a & b, out), T.BooleanType())

    def _compare(self, op, a: Value, b: Value) -> Column:
        if isinstance(op, (ast.In, ast.NotIn)):
            found = self._member(a, b)
            return ~found if isinstance(op, ast.NotIn) else found
        if type(op) not in _COMPARE:
            raise ExpressionError(f"{type(op).__name__} isn't allowed in an expression")
        a, b = self._labels(op, a, b), self._labels(op, b, a)
        equal = isinstance(op, (ast.Eq, ast.NotEq))
        if equal and (a.is_array or b.is_array):
            same = self._array_equal(a, b)
            return ~same if isinstance(op, ast.NotEq) else same
        if a.is_literal and a.literal is None or b.is_literal and b.literal is None:
            if not equal:
                raise ExpressionError("None has no order")
            null = (b if a.is_literal else a).get().isNull()
            return ~null if isinstance(op, ast.NotEq) else null
        made = F.coalesce(_COMPARE[type(op)](a.get(), b.get()), F.lit(isinstance(op, ast.NotEq)))
        return made

    @staticmethod
    def _labels(op, value: Value, other: Value) -> Value:
        """A class name beside a label column becomes its id; an unknown one none at all."""
        if other.names is None or not isinstance(value.literal, str):
            return value
        if not isinstance(op, (ast.Eq, ast.NotEq, ast.In, ast.NotIn)):
            raise ExpressionError("class names have no order")
        return Value(None, None, other.names.index(value.literal) if value.literal in other.names else -1)

    def _member(self, a: Value, b: Value) -> Column:
        if b.names is not None and isinstance(a.literal, str):
            a = self._labels(ast.In(), a, b)
        if isinstance(b.literal, (list, tuple)) and not a.is_array:
            values = [self._labels(ast.In(), Value(None, None, v), a).literal for v in b.literal]
            return F.coalesce(a.get().isin(values), F.lit(False)) if values else F.lit(False)
        if isinstance(b.kind, T.ArrayType):
            return F.coalesce(F.array_contains(self._flat(b), a.get()), F.lit(False))
        if isinstance(b.kind, T.StringType) or isinstance(b.literal, str):
            return F.coalesce(F.contains(b.get(), a.get()), F.lit(False))
        # A scalar cell counts as an array of one.
        return F.coalesce(b.get() == a.get(), F.lit(False))

    @staticmethod
    def _flat(value: Value) -> Column:
        c, kind = value.get(), value.kind
        while isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.ArrayType):
            c, kind = F.flatten(c), kind.elementType
        return c

    def _array_equal(self, a: Value, b: Value) -> Column:
        if not a.is_array:
            a, b = b, a
        if not b.is_array:
            return F.coalesce(F.array_contains(self._flat(a), b.get()), F.lit(False))
        x, y = self._flat(a), self._flat(b)
        return F.coalesce((F.size(F.array_except(x, y)) == 0) & (F.size(F.array_except(y, x)) == 0), F.lit(False))


def parse(text: str) -> ast.Expression:
    """The syntax tree; ExpressionError if the text is no expression."""
    if not isinstance(text, str) or not text.strip():
        raise ExpressionError("an expression is needed")
    try:
        return ast.parse(text.strip(), mode="eval")
    except (SyntaxError, ValueError, RecursionError, MemoryError) as error:
        raise ExpressionError(f"no expression: {error}") from error


def validate(text: str) -> list[str]:
    """Checks that an expression uses only what is allowed; the names that it refers to."""
    allowed = (ast.Expression, ast.Constant, ast.Name, ast.Load, ast.List, ast.Tuple, ast.Attribute, ast.Subscript, ast.UnaryOp, ast.BinOp, ast.BoolOp, ast.Compare, ast.operator, ast.unaryop, ast.boolop, ast.cmpop)
    names = []
    for node in ast.walk(parse(text)):
        if not isinstance(node, allowed):
            raise ExpressionError(f"{type(node).__name__} isn't allowed in an expression")
        if isinstance(node, ast.Attribute) and node.attr.startswith("_") or isinstance(node, ast.Name) and node.id.startswith("_"):
            raise ExpressionError("private names aren't allowed in an expression")
        if isinstance(node, (ast.Is, ast.IsNot, ast.Invert, ast.BitAnd, ast.BitOr, ast.BitXor, ast.LShift, ast.RShift, ast.MatMult)):
            raise ExpressionError(f"{type(node).__name__} isn't allowed in an expression")
        if isinstance(node, ast.Name):
            names.append(node.id)
    return list(dict.fromkeys(names))


def class_names(schema: T.StructType) -> dict[str, list[str]]:
    """Class names of label columns, from the fields' metadata."""
    import json

    return {f.name: json.loads(f.metadata["class_names"]) for f in schema.fields if f.metadata and "class_names" in f.metadata}


def compile_value(text: str, schema: T.StructType) -> Value:
    validate(text)
    compiler = _Compiler({f.name: f for f in schema.fields}, class_names(schema))
    return compiler.visit(parse(text))


def compile_expression(text: str, schema: T.StructType) -> Column:
    """The expression's truth as a column that is never null."""
    return truth(compile_value(text, schema))
