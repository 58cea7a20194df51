"""Formulas to Spark columns.

``Compiler(df)`` turns a formula over a table's columns into one column, so
that Catalyst folds, prunes and generates code for it. Names are columns;
aggregates of columns become Spark aggregates (``aggregate``) or windows where
the argument is a directional range (``over_rows``).
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from sheetwright.functions import scalars
from sheetwright.functions import values as V
from sheetwright.functions.values import Val
from sheetwright.plans import syntax as S

#: Names of aggregates.
AGGREGATES = ("SUM", "AVERAGE", "AVG", "COUNT", "COUNTA", "MIN", "MAX", "PRODUCT", "MEDIAN", "COUNTIF", "SUMIF", "AND", "OR", "CONCAT", "CONCATENATE")


def parse(formula: str):
    """The tree, or an error literal: a formula that can't be read has the value #SYNTAX!."""
    try:
        return S.parse(formula)
    except S.FormulaSyntaxError:
        return S.ErrorLiteral(V.SYNTAX)


def literal(node: S.Literal) -> Val:
    if node.value is None:
        return V.empty()
    if isinstance(node.value, bool):
        return V.boolean(F.lit(node.value))
    return V.text(F.lit(node.value)) if isinstance(node.value, str) else V.number(F.lit(float(node.value)))


def _middle(numbers: Column) -> Column:
    """The median of a sorted array; null for an empty one."""
    n = F.size(numbers)
    low, high = F.get(numbers, F.floor((n - 1) / 2).cast("int")), F.get(numbers, F.floor(n / 2).cast("int"))
    return F.when(n > 0, (low + high) / 2)


class Compiler:
    def __init__(self, df: DataFrame, names: dict[str, str] | None = None):
        """names: formula names to columns; the columns' own names work as well, without case."""
        self.known = {f.name.lower(): (f.name, f.dataType) for f in df.schema.fields}
        self.names = {k.lower(): v.lower() for k, v in (names or {}).items()}

    # -- scalars

    def value(self, node) -> Val:
        if isinstance(node, S.Literal):
            return literal(node)
        if isinstance(node, S.ErrorLiteral):
            return V.error(node.code)
        if isinstance(node, S.Name):
            key = self.names.get(node.name.lower(), node.name.lower())
            return V.of_column(*self.known[key]) if key in self.known else V.error(V.NAME)
        if isinstance(node, S.Unary):
            return scalars.unary(node.op, self.value(node.of))
        if isinstance(node, S.Binary):
            return scalars.binary(node.op, self.value(node.left), self.value(node.right))
        if isinstance(node, S.Call):
            return self.call(node)
        return V.error(V.REF)  # cell addresses have no meaning in a table of named columns

    def call(self, node: S.Call) -> Val:
        found = scalars.FUNCTIONS.get(node.name)
        if found is None:
            return V.error(V.NAME)
        least, most, build = found
        if not least <= len(node.args) <= most:
            return V.error(V.VALUE)
        return build(*[self.value(a) for a in node.args])

    def scalar(self, formula: str) -> Val:
        return self.value(parse(formula))

    def number(self, formula: str) -> Column:
        """The formula's number; null where it is an error."""
        v, err = V.as_number(self.scalar(formula))
        return v if err is None else F.when(err.isNull(), v)

    def text(self, formula: str) -> Column:
        v = self.scalar(formula)
        err = V.err_of(v)
        return V.as_text(v) if err is None else F.coalesce(err, V.as_text(v))

    def boolean(self, formula: str) -> Column:
        v, err = V.as_boolean(self.scalar(formula))
        return v if err is None else F.when(err.isNull(), v)

    def error(self, formula: str) -> Column:
        err = V.err_of(self.scalar(formula))
        return F.lit(None).cast("string") if err is None else err

    # -- aggregates

    def aggregate(self, formula: str, order: str | None = None, over: WindowSpec | None = None) -> Val:
        """An aggregate over the rows of a group, or of a window's frame.

        order: a column that ranks the rows; the first error in this order is the result's.
        """
        node = parse(formula)
        return self._aggregate(node, order, over)

    def aggregate_number(self, formula: str, order: str | None = None, over: WindowSpec | None = None) -> Column:
        v, err = V.as_number(self.aggregate(formula, order, over))
        return v if err is None else F.when(err.isNull(), v)

    def _aggregate(self, node, order, over) -> Val:
        if isinstance(node, S.Binary):
            return scalars.binary(node.op, self._aggregate(node.left, order, over), self._aggregate(node.right, order, over))
        if isinstance(node, S.Unary):
            return scalars.unary(node.op, self._aggregate(node.of, order, over))
        if isinstance(node, (S.Literal, S.ErrorLiteral)):
            return self.value(node)
        if isinstance(node, S.Call) and node.name not in AGGREGATES:
            least, most, build = scalars.FUNCTIONS.get(node.name, (0, -1, None))
            if build is None:
                return V.error(V.NAME)
            return build(*[self._aggregate(a, order, over) for a in node.args]) if least <= len(node.args) <= most else V.error(V.VALUE)
        if not isinstance(node, S.Call):
            return V.error(V.VALUE)
        run = (lambda c: c.over(over)) if over is not None else (lambda c: c)
        return self._call_aggregate(node, order, run, over is not None)

    def _call_aggregate(self, node: S.Call, order, run, windowed: bool) -> Val:
        name, args = node.name, node.args
        if name in ("COUNTIF", "SUMIF"):
            return self._conditional(node, run)
        if not args:
            return V.error(V.VALUE)
        cells = [self.value(a) for a in args]
        numbers, errors = [], []
        for v in cells:
            kind = V.err_of(v)
            n = v.col if v.kind == "number" else v.col["n"] if v.kind == "any" else F.lit(None).cast("double")
            numbers.append(n if kind is None else F.when(kind.isNull(), n))  # only cells that are numbers count
            if kind is not None and name not in ("COUNT", "COUNTA"):
                errors.append(run(F.min_by(kind, F.when(kind.isNotNull(), F.col(order))) if order else F.min(kind)))
        err = V.first_error(*errors)
        parts = lambda of: [run(of(n)) for n in numbers]
        added = lambda columns: functools.reduce(operator.add, columns)
        pick = lambda of, columns: of(*columns) if len(columns) > 1 else columns[0]
        if name == "SUM":
            return V.guard(added([F.coalesce(x, F.lit(0.0)) for x in parts(F.sum)]), err)
        if name in ("AVERAGE", "AVG"):
            mean = run(F.avg(numbers[0])) if len(numbers) == 1 else F.try_divide(added([F.coalesce(x, F.lit(0.0)) for x in parts(F.sum)]), added(parts(F.count)))
            return V.number(mean, V.first_error(err, F.when(mean.isNull(), F.lit(V.DIV0))))
        if name == "COUNT":
            return V.number(added(parts(F.count)).cast("double"))
        if name == "COUNTA":
            return V.number(added([run(F.count_if(~V.is_empty(v))) for v in cells]).cast("double"))
        if name == "MIN":
            return V.number(F.coalesce(pick(F.least, parts(F.min)), F.lit(0.0)), err)
        if name == "MAX":
            return V.number(F.coalesce(pick(F.greatest, parts(F.max)), F.lit(0.0)), err)
        if name == "PRODUCT":
            some = functools.reduce(operator.or_, [x > 0 for x in parts(F.count)])
            product = functools.reduce(operator.mul, [F.coalesce(x, F.lit(1.0)) for x in parts(F.product)])
            return V.guard(F.when(some, product).otherwise(F.lit(0.0)), err)
        if name == "MEDIAN":
            middle = run(F.median(numbers[0])) if len(numbers) == 1 and not windowed else _middle(F.array_sort(pick(F.concat, parts(F.collect_list))))
            return V.number(middle, V.first_error(err, F.when(middle.isNull(), F.lit(V.NUM))))
        if name in ("AND", "OR"):
            found, bad = [], []
            for v in cells:
                got, wrong = V.as_boolean(v)
                found.append(F.coalesce(run((F.bool_and if name == "AND" else F.bool_or)(got)), F.lit(name == "AND" and len(cells) > 1)))
                bad += [run(F.min(wrong))] if wrong is not None else []
            return V.boolean(functools.reduce(operator.and_ if name == "AND" else operator.or_, found), V.first_error(err, *bad))
        texts = []
        for v in cells:
            rows = F.array_sort(run(F.collect_list(F.struct(F.col(order) if order else F.lit(0), V.as_text(v).alias("s")))))
            texts.append(F.array_join(F.transform(rows, lambda x: x["s"]), ""))
        return V.text(pick(F.concat, texts), err)

    def _conditional(self, node: S.Call, run) -> Val:
        name, args = node.name, node.args
        if not 2 <= len(args) <= (3 if name == "SUMIF" else 2):
            return V.error(V.VALUE)
        wanted = args[1]
        if isinstance(wanted, S.ErrorLiteral):
            return V.error(wanted.code)
        if isinstance(wanted, S.Unary) and wanted.op == "-" and isinstance(wanted.of, S.Literal):
            wanted = S.Literal(-wanted.of.value)
        if not isinstance(wanted, S.Literal):
            return V.error(V.VALUE)  # a criterion is a constant of the plan
        test = V.criteria(self.value(args[0]), wanted.value if wanted.value is not None else "")
        if name == "COUNTIF":
            return V.number(run(F.count_if(test)).cast("double"))
        n, err = V.as_number(self.value(args[2] if len(args) == 3 else args[0]))
        if err is not None:  # cells that are no number are passed over
            n = F.when(err.isNull(), n)
        return V.guard(F.coalesce(run(F.sum(F.when(test, n))), F.lit(0.0)), None)

    # -- directional ranges

    def over_rows(self, formula: str, window: WindowSpec, column: str) -> Val:
        """An aggregate like SUM(ABOVE) over ``column``; ``window``: a table's column in row order."""
        node = parse(formula)
        if not (isinstance(node, S.Call) and len(node.args) >= 1 and isinstance(node.args[0], S.Direction)):
            return V.error(V.VALUE)
        before = node.args[0].kind in ("ABOVE", "LEFT")
        from pyspark.sql import Window

        frame = window.rowsBetween(Window.unboundedPreceding, -1) if before else window.rowsBetween(1, Window.unboundedFollowing)
        return self._aggregate(S.Call(node.name, (S.Name(column), *node.args[1:])), None, frame)
