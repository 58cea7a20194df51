"""List numbering: definitions with nine levels, and the simple numbering by kind and indent.

The simple numbering is windows: a new list begins where a paragraph is none,
and a level's count begins again where a shallower item stood between. The
definition-based numbering carries counters from paragraph to paragraph and is
a fold for each document and counter group, which share no state.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheetwright.functions import numbering
from sheetwright.operators.folds import fold_groups

LEVELS = 9
NUMBERED = "doc_id long, position long, label string, ordinal int"

#: Formats of the simple numbering by depth, and numbers that a legal level keeps.
SIMPLE_FORMATS = ("Decimal", "LowerAlphabetic", "LowerRoman")
ARABIC = ("Decimal", "DecimalZero", "DecimalZero3", "DecimalZero4", "DecimalZero5")


def simple_labels(paras: DataFrame, keys: list[str], order: str, kind: str = "list_kind", level: str = "indent_level") -> DataFrame:
    """Adds label: numbers or bullets by depth; paragraphs outside lists have none and end all lists."""
    w = Window.partitionBy(*keys).orderBy(order)
    outside = F.col(kind) == "None"
    base = paras.withColumn("list_no", F.sum(outside.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    numbered = (F.col(kind) == "Number") & ~outside
    depth = F.greatest(F.col(level) - 1, F.lit(0))
    # the count of a level begins again behind every listed paragraph of a shallower level
    out = base
    counts = []
    most = LEVELS + 1
    for k in range(most):
        in_list = Window.partitionBy(*keys, "list_no").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        cut = f"cut_{k}"
        out = out.withColumn(cut, F.sum(((F.col(level) < k) & ~outside).cast("int")).over(in_list))
        span = Window.partitionBy(*keys, "list_no", cut).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        counts.append(F.when(F.col(level) == k, F.sum((numbered & (F.col(level) == k)).cast("int")).over(span)))
    number = F.coalesce(*counts)
    out = out.withColumn("number", F.when(numbered, number))
    text = F.when(depth % 3 == 0, numbering.column(F.col("number"), SIMPLE_FORMATS[0])).when(depth % 3 == 1, numbering.column(F.col("number"), SIMPLE_FORMATS[1])).otherwise(numbering.column(F.col("number"), SIMPLE_FORMATS[2]))
    bullet = F.get(F.array(*map(F.lit, numbering.BULLETS)), depth % 3)
    label = F.when(F.col(kind) == "Bullet", bullet).when(numbered, F.concat(text, F.lit(".")))
    return out.withColumn("label", label).drop("list_no", *[f"cut_{k}" for k in range(most)])


class Definition:
    """A list's nine levels, compiled: each template's texts and the levels of the numbers between them, and what restarts behind a level."""

    def __init__(self, levels: list[dict]):
        self.levels = full_levels(levels)
        split = [re.split(r"%([1-9])", level["template"]) for level in self.levels]
        self.texts = [parts[::2] for parts in split]
        self.numbers = [[int(d) - 1 for d in parts[1::2]] for parts in split]
        self.starts = {k: level["start"] for k, level in enumerate(self.levels)}
        after = [k - 1 if level["restart_after"] is None else level["restart_after"] for k, level in enumerate(self.levels)]
        self.restarted = [{deeper for deeper in range(k + 1, LEVELS) if after[deeper] >= k} for k in range(LEVELS)]

    def _number(self, own: dict, k: int, numbers: dict[int, int]) -> str:
        shown = self.levels[k]["format"]
        return numbering.label(numbers[k], "Decimal" if own["legal"] and shown not in (*ARABIC, "Bullet") else shown)

    def label(self, level: int, numbers: dict[int, int]) -> str | None:
        """The label of ``level``. A number of a level without format goes, with the text between it and the next number; such a level's own label keeps its outer texts."""
        own, texts, shown = self.levels[level], self.texts[level], self.numbers[level]
        if own["format"] == "Bullet":
            made = own["template"]
        elif own["format"] == "None" and shown:
            made = texts[0].partition("%")[0] + texts[-1].rpartition("%")[2]
        else:
            blank, last = [self.levels[k]["format"] == "None" for k in shown], len(shown) - 1
            made = texts[0] + "".join(("" if b else self._number(own, k, numbers)) + ("" if b and i < last else texts[i + 1]) for i, (k, b) in enumerate(zip(shown, blank, strict=True)))
        return made if made.strip() else None


def next_numbers(numbers: dict[int, int], level: int, starts: dict[int, int], restarted: set[int], restart: int | None = None) -> dict[int, int]:
    """The numbers by level once ``level`` goes on: outer levels that have none get their start, restarted ones lose theirs."""
    own = restart if restart is not None else numbers[level] + 1 if level in numbers else starts[level]
    outer = {k: starts[k] for k in range(level)}
    return outer | {k: n for k, n in numbers.items() if k not in restarted} | {level: own}


def full_levels(levels: list[dict]) -> list[dict]:
    """Nine levels; missing ones are decimal."""
    base = [{"format": "Decimal", "template": f"%{k + 1}.", "start": 1, "legal": False, "restart_after": None} for k in range(LEVELS)]
    return [b | {k: v for k, v in (levels[i] if i < len(levels) else {}).items() if v is not None} for i, b in enumerate(base)]


def number_lists(items: DataFrame, definitions: dict[str, dict]) -> DataFrame:
    """Labels of ``items`` (doc_id, position, definition, level, restart) under ``definitions``.

    definitions: name to {"group": name, "levels": [...]}. A document's list items of one group are one fold.
    """
    known_lists = {name: Definition(d.get("levels", [])) for name, d in definitions.items()}
    group = {name: d.get("group") or name for name, d in definitions.items()}

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        numbers: dict[int, int] = {}
        starts, seen, rows = None, set(), []
        for c in frame.sort_values("position", kind="stable").itertuples():
            used = known_lists[c.definition]
            if starts is None or (c.definition not in seen and group[c.definition] != c.definition):  # a further list of a group begins anew
                starts, numbers = used.starts, {}
            seen.add(c.definition)
            level = max(0, min(int(c.level), LEVELS - 1))
            numbers = next_numbers(numbers, level, starts, used.restarted[level], None if pd.isna(c.restart) else int(c.restart))
            rows.append((c.doc_id, c.position, used.label(level, starts | numbers), numbers[level]))
        return pd.DataFrame(rows, columns=["doc_id", "position", "label", "ordinal"])

    pairs = F.create_map(*[F.lit(x) for p in group.items() for x in p])
    known = items.select(F.col("doc_id").cast("long"), F.col("position").cast("long"), "definition", "level", "restart").withColumn("counter_group", pairs[F.col("definition")])
    return fold_groups(known.where("counter_group is not null"), ["doc_id", "counter_group"], fold, NUMBERED)
