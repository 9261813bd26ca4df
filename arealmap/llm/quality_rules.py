"""Quality rules, line by line first: lines that fail go, then documents that lose too much text.

A line fails the punctuation rule if it doesn't end in a mark that ends a sentence;
the navigation rule if it is a row of items between separators, or a short line
with a menu's words; the boilerplate rule if it holds a stock phrase, if many of
its words carry mark-up symbols, or if most words repeat the word before.  Lines
without a word are layout and never fail.  What stays, joined as it was, is the cleaned
text; a document is kept if it passes the base rules and no more than ``MOST_LOST``
of the characters of its words went with failed lines.

Everything about a text is told from that text, so a document is one row of a task
and nothing is shuffled.  A text is read in stretches of ``STRETCH`` characters, cut
between words; its words are held as numbers of 4 bytes, and distinct words
once, so a very long text costs a small multiple of itself.

Defined cases: a null text has no words, and no cleaned text (null); an empty text
is cleaned to itself; both have fewer words than the base rules ask for, so
they are not kept.  A share exactly at a threshold passes.  Rows are judged one by
one, so ties, repeated rows and null ids change nothing; an empty table gives an
empty result; other columns travel along inside one of their own, whatever they are called.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import SPACE, few_at_a_time, wrapped

#: Base rules: fewest words, and most words of a hundred in repeated windows of three.
FEWEST_WORDS, MOST_REPEATED = 50, 50
#: Share of a text's word characters that may go with failed lines.
MOST_LOST = 0.3
#: Shares of a line's words: separators, words with symbols, words like the one before.
SEPARATORS, SYMBOLS, ECHOES = 1 / 6, 1 / 5, 1 / 2
#: Words of a line short enough to be a menu's.
MENU_WORDS = 8
STRETCH = 1 << 20

#: Marks that end a sentence, separators of menus, symbols of mark-up, and stock phrases in lower case.
ENDS = ".!?…\"'”’»)]。！？؟।"
SEPARATOR_WORDS = ("|", ">", "»", "›", "·", "•", "/", "::")
MARKUP = "#*$%&|<>"
MENU = ("home", "menu", "next", "previous", "read more", "click here", "log in", "sign in", "sign up", "share", "back to top", "contact us", "about us")
STOCK = ("all rights reserved", "terms of use", "terms of service", "privacy policy", "use of cookies", "enable javascript", "lorem ipsum", "copyright ©", "©")

WORD = re.compile(f"[^{SPACE}]+")
MENU_LINE = re.compile("(?:^|[^a-z])(?:" + "|".join(MENU) + ")(?:[^a-z]|$)")
#: Words with at least two symbols, or one at their end.
SYMBOLIC = re.compile(f"[{re.escape(MARKUP)}].*[{re.escape(MARKUP)}]|.[{re.escape(MARKUP)}]$")
BLANKS = " \t\n\x0b\x0c\r"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class Rules:
    """Thresholds; None switches a rule off."""

    punctuation: bool = True
    separators: float | None = SEPARATORS
    menu_words: int | None = MENU_WORDS
    symbols: float | None = SYMBOLS
    echoes: float | None = ECHOES
    stock: tuple[str, ...] = STOCK
    most_lost: float = MOST_LOST
    fewest_words: int = FEWEST_WORDS
    most_repeated: int = MOST_REPEATED

    def failed(self, line: Line) -> str | None:
        """The first rule that a line with words fails."""
        n = line.n
        if self.punctuation and line.last[-1] not in ENDS:
            return "punctuation"
        if self.separators is not None and line.apart >= 2 and line.apart > self.separators * n:
            return "navigation"
        low = line.text.translate(FOLD)
        if self.menu_words is not None and n <= self.menu_words and MENU_LINE.search(low):
            return "navigation"
        if any(phrase in low for phrase in self.stock):
            return "boilerplate"
        if self.symbols is not None and line.symbolic > self.symbols * n:
            return "boilerplate"
        if self.echoes is not None and line.echoes > self.echoes * n:
            return "boilerplate"
        return None


@dataclass
class Line:
    """A line's words, counted stretch by stretch: all, separators, those with symbols, those like the one before, and the last."""

    text: str
    n: int = 0
    apart: int = 0
    symbolic: int = 0
    echoes: int = 0
    last: str = ""

    def add(self, words: list[str], separators: bool, symbols: bool) -> None:
        self.n += len(words)
        self.echoes += sum(map(eq, words, words[1:])) + (words[0] == self.last)
        self.last = words[-1]
        if separators:
            self.apart += sum(map(words.count, SEPARATOR_WORDS))
        if symbols:
            self.symbolic += sum(map(bool, map(SYMBOLIC.search, words)))


def blanks(text: str) -> int:
    return sum(map(text.count, BLANKS))


def stretches(text: str, most: int = STRETCH) -> Iterator[str]:
    """The text in pieces that cut no word."""
    start, n = 0, len(text)
    while start < n:
        end = min(start + most, n)
        while end < n and text[end] not in BLANKS:
            end += 1
        yield text[start:end]
        start = end


class Numbers:
    """Words as numbers, equal words as equal ones."""

    def __init__(self):
        self.known: dict[str, int] = {}
        self.parts: list[np.ndarray] = []

    def add(self, words: list[str]) -> None:
        for w in dict.fromkeys(words):
            if w not in self.known:
                self.known[w] = len(self.known)
        self.parts.append(np.fromiter(map(self.known.__getitem__, words), np.int32, len(words)))

    def all(self) -> np.ndarray:
        return np.concatenate(self.parts) if self.parts else np.zeros(0, np.int32)


def repeated_words(ids: np.ndarray) -> int:
    """Words that lie in a window of three which the text has twice or more."""
    n = len(ids) - 2
    if n < 2:
        return 0
    # Equal pairs get equal numbers below n + 1, so pairs of these and the third word fit a long.
    size = int(ids.max()) + 1
    pair = ids[:-2].astype(np.int64) * size + ids[1:-1]
    if size > 1 << 20:
        pair = np.unique(pair, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(window := pair * size + ids[2:], kind="stable")
    same = window[order[1:]] == window[order[:-1]]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    covered = np.zeros(n + 2, bool)
    for k in range(3):
        covered[k : n + k] |= twice
    return int(covered.sum())


def judged(text: str | None, rules: Rules) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lost_chars, failed lines by rule, cleaned text)."""
    if text is None:
        return 0, 0, 0, 0, 0, 0, {}, None
    numbers, seen = Numbers(), set()
    lost, dup, failed, kept = 0, 0, {}, []
    # What no line has needs no look at its words.
    separators, symbols = any(x in text for x in SEPARATOR_WORDS), sum(map(text.count, MARKUP))
    for whole in text.split("\n"):
        line = Line(whole)
        for x in stretches(whole):
            words = WORD.findall(x)
            if words:
                numbers.add(words)
                line.add(words, separators, symbols > 0)
        if not line.n:
            kept.append(whole)
            continue
        dup += whole in seen
        seen.add(whole)
        rule = rules.failed(line)
        if rule is None:
            kept.append(whole)
        else:
            lost += len(whole) - blanks(whole)
            failed[rule] = failed.get(rule, 0) + 1
    ids = numbers.all()
    return len(ids), len(text) - blanks(text), symbols, dup, repeated_words(ids), lost, failed, "\n".join(kept)


OUT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lost_chars long, failed_lines map<string,long>, clean_text string, base_failed boolean, kept boolean"


def clean(docs: DataFrame, rules: Rules = Rules(), texts: bool = True) -> DataFrame:
    """(record, doc_id, counts, failed_lines by rule, clean_text, base_failed, kept) of every row; without ``texts`` no cleaned text."""

    more = StructType.fromDDL(OUT).fields
    names = ["record", "doc_id", *(f.name for f in more)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_at_a_time(batches, 500):
            held = [[] for _ in range(10)]
            for text in batch.column("text"):
                n, chars, symbols, dup, again, lost, failed, left = judged(text.as_py(), rules)
                base = n < rules.fewest_words or 100 * again > rules.most_repeated * n
                row = (n, chars, symbols, dup, again, lost, list(failed.items()), left if texts else None, base, not base and lost <= rules.most_lost * chars)
                for column, value in zip(held, row, strict=True):
                    column.append(value)
            kinds = [pa.int64()] * 6 + [pa.map_(pa.string(), pa.int64()), pa.string(), pa.bool_(), pa.bool_()]
            new = [pa.array(x, t) for x, t in zip(held, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("record"), batch.column("doc_id"), *new], names)

    rows = wrapped(docs)
    shape = StructType([rows.schema["record"], StructField("doc_id", rows.schema["doc_id"].dataType), *more])
    return rows.mapInArrow(run, shape)


def keep_clean(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows that are kept, with their failed lines gone from ``text``."""
    left = clean(docs, rules).where("kept")
    return left.select(*(F.col("clean_text").alias(c) if c == "text" else F.col(f"record.`{c}`").alias(c) for c in docs.columns))


def sql(rules: Rules = Rules()) -> str:
    """The counts and verdicts of ``clean`` in SQL, word by word and line by line."""
    listed = lambda words: ", ".join("'" + w.replace("'", "''") + "'" for w in words)
    markup, ends = re.escape(MARKUP), ENDS.replace("'", "''")
    symbolic = f"[{markup}].*[{markup}]|.[{markup}]$"
    fails = f"""NOT contains('{ends}', right(lw[-1], 1))
    OR (len(list_filter(lw, lambda x: x IN ({listed(SEPARATOR_WORDS)}))) >= 2 AND len(list_filter(lw, lambda x: x IN ({listed(SEPARATOR_WORDS)}))) > CAST({rules.separators!r} AS DOUBLE) * len(lw))
    OR (len(lw) <= {rules.menu_words} AND regexp_matches(low, '(?:^|[^a-z])(?:{"|".join(MENU)})(?:[^a-z]|$)'))
    OR {" OR ".join(f"contains(low, {listed([x])})" for x in rules.stock)}
    OR len(list_filter(lw, lambda x: regexp_matches(x, '{symbolic}'))) > CAST({rules.symbols!r} AS DOUBLE) * len(lw)
    OR len(list_filter(list_zip(lw[1:-2], lw[2:]), lambda z: z[1] = z[2])) > CAST({rules.echoes!r} AS DOUBLE) * len(lw)"""
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^{SPACE}]+') AS ws, length(regexp_replace(t, '[{SPACE}]+', '', 'g')) AS chars FROM d),
g AS (SELECT r, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i:i + 2])) AS g, unnest(range(1, len(ws) - 1)) AS p FROM w),
a AS (SELECT r, count(DISTINCT p + k.range) AS again FROM (SELECT r, p, count(*) OVER (PARTITION BY r, g) AS n FROM g), range(3) k WHERE n > 1 GROUP BY r),
l AS (SELECT r, line, regexp_extract_all(line, '[^{SPACE}]+') AS lw, translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d)),
s AS (SELECT r, count(*) - count(DISTINCT line) AS dup, coalesce(sum(length(array_to_string(lw, ''))) FILTER ({fails}), 0) AS lost FROM l WHERE len(lw) > 0 GROUP BY r),
e AS (SELECT *, len(ws) AS n, coalesce(again, 0) AS ag, len(ws) < {rules.fewest_words} OR 100 * coalesce(again, 0) > {rules.most_repeated} * len(ws) AS bad FROM w LEFT JOIN a USING (r) LEFT JOIN s USING (r))
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(chars AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[{markup}]')) AS BIGINT) AS n_symbols,
  CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines, CAST(ag AS BIGINT) AS n_repeat_words, bad AS base_failed, NOT bad AND coalesce(lost, 0) <= CAST({rules.most_lost!r} AS DOUBLE) * chars AS kept
FROM e
"""
