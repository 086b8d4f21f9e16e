"""Fill-in-the-middle texts by a streaming matcher in constant memory.

A text is cut after two of its n units (lines, words, or any pattern), whose ranks come from a hash of its id.  The first pass over a
text only counts its matches; the second advances one lazy iterator of matches to the smaller rank and on to the larger, and keeps the
two ends alone.  No list of units, or of their places, is made, so a text of any length takes its own size and its output's.

Defined cases: null or empty text has no units and stays as it is, as does a text that holds one of the marks (form ``plain``); a null
id hashes like the empty text; rows of one id are cut at the same ranks of their own units; what lies between or after the matches of a
pattern that doesn't cover the text stays where it stands; other columns are kept, and clashing names avoided by underscores.
"""

from __future__ import annotations

import hashlib
import re
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import map_arrow, unused, with_fields

LINES = r"[^\n]*\n|[^\n]+"
WORDS = r"\S+\s*|\s+"
#: what stands before the prefix, the suffix and the middle
MARKS = ("<P>", "<S>", "<M>")
NAMES = ("_n", "_form", "_prefix_chars", "_middle_chars", "_output")


def outputs(docs: DataFrame) -> list[str]:
    """The names that transform() gives its columns beside those of docs, in the order of NAMES."""
    return unused(docs.columns, *NAMES)


def ranks(seed: int, of) -> tuple[int, int, int, int]:
    """The first four groups of eight hex digits of sha256("seed:id")."""
    h = hashlib.sha256(f"{seed}:{'' if of is None else of}".encode()).hexdigest()
    return int(h[:8], 16), int(h[8:16], 16), int(h[16:24], 16), int(h[24:32], 16)


def cut_points(text: str, unit: re.Pattern, h1: int, h2: int) -> tuple[int, int, int]:
    """(units, end of the prefix, end of the middle): two passes over the matches, neither of which keeps them."""
    n = sum(1 for _ in unit.finditer(text))
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    ends = (m.end() for m in unit.finditer(text))
    first = next(islice(ends, low - 1, None)) if low else 0
    second = next(islice(ends, high - low - 1, None)) if high > low else first
    return n, first, second


def _checked(marks: tuple[str, str, str]) -> tuple[str, str, str]:
    """Marks begin with a character that they hold nowhere else and none begins another, so no text beside a mark can make up another one."""
    if len(marks) != 3 or any(not m or any(o.find(m[0], 1) >= 0 for o in marks) for m in marks) or any(a is not b and b.startswith(a) for a in marks for b in marks):
        raise ValueError(f"marks can't be told apart in a text: {marks}")
    return marks


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = LINES, rate: int = 100, spm: int = 50, seed: int = 7, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """All rows of docs with ``_n`` (units), ``_form`` (plain, psm, spm), ``_prefix_chars``, ``_middle_chars`` (null if plain) and ``_output`` (the text in its new order).

    ``rate`` percent of the texts are cut, ``spm`` percent of those with the suffix first.  Map only.
    """
    p, s, m = _checked(marks)
    names = outputs(docs)
    kinds = ("long", "string", "long", "long", "string")

    def step(batch):
        pattern = re.compile(unit)
        made = [[] for _ in NAMES]
        for of, text in zip(batch.column(id_col), batch.column(text_col), strict=True):
            text = text.as_py() or ""
            h1, h2, h3, h4 = ranks(seed, of.as_py())
            n, a, b = cut_points(text, pattern, h1, h2)
            if not text or any(x in text for x in marks) or h3 % 100 >= rate:
                row = (n, "plain", None, None, text)
            elif h4 % 100 < spm:
                row = (n, "spm", a, b - a, "".join((s, text[b:], p, text[:a], m, text[a:b])))
            else:
                row = (n, "psm", a, b - a, "".join((p, text[:a], s, text[b:], m, text[a:b])))
            for to, v in zip(made, row, strict=True):
                to.append(v)
        types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
        more = {k: pa.array(v, t) for k, v, t in zip(names, made, types, strict=True)}
        return pa.Table.from_pydict({c: batch.column(c) for c in batch.schema.names} | more)

    return map_arrow(docs, step, with_fields(docs, *zip(names, kinds, strict=True)), text_col)


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text as it was, from the output and its form alone: marks split it into its three parts."""
    parts = F.split(output, "|".join(re.escape(x) for x in _checked(marks)), -1)
    at = lambda k: F.element_at(parts, k)  # noqa: E731  (what stands before the first mark is empty)
    return F.when(form == "plain", output).when(form == "psm", F.concat(at(2), at(4), at(3))).otherwise(F.concat(at(3), at(4), at(2)))
