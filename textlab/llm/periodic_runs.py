"""Periodic runs of words, by suffix automaton with link-cut access.

A *run* is a stretch of consecutive words with smallest period ``q`` (words
``q`` apart are identical) that no neighbouring word extends, at least
``min_length`` words and ``min_exponent`` periods long.

1. *Where runs can be.*  In a run of at least ``min_length`` words and three
   periods every word lies in a window of ``min_length - min_length // 3`` words
   that occurs again in the run.  Windows are compared by 64-bit hashes (equal
   windows always have equal hashes), and only the maximal stretches that
   repeated windows cover go on; a run lies in one of them as a whole.
2. *Squares.*  A suffix automaton is built over each stretch.  Its suffix links
   form a tree in which the path from the state of a prefix to the root holds
   all suffixes of that prefix.  Words are appended one by one: the *access*
   operation of a link-cut tree walks the segments of that path, each with one
   last end ``e`` and a longest string of ``l`` words, and recolours the path
   with the new end ``r``.  If ``r - e <= l``, the last ``r - e`` words occur
   at ``e`` and at ``r``: a square.  Every run has its period among these.
3. *Runs.*  A square of period ``p`` that no earlier run of period ``p`` covers
   is extended word by word to both sides, and kept if it is long enough and
   ``p`` is its smallest period.

Appending costs amortised logarithmic numbers of segments and of rotations.
Memory is some 600 bytes a word of the longest single stretch that repeats;
texts without repeats need 40 bytes a word.  Documents never meet, so nothing
moves between tasks.

Cases: null and empty texts have no words and no runs; words are compared as
bytes; a text that is one run is one stretch; of equal best runs the smallest
start and then the smallest period is ``best``; repeated rows are treated per
row; an empty table gives an empty result; input columns named like an output
are replaced, others are kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import without

MIN_LENGTH = 24
MIN_EXPONENT = 3
_MIX = 0x9E3779B97F4A7C15


def suffix_automaton(word: Sequence[int]) -> tuple[list[int], list[int], list[int]]:
    """Suffix links, longest lengths, and the state of each prefix."""
    follow: list[dict[int, int]] = [{}]
    link, longest, last, prefix = [-1], [0], 0, []
    for c in word:
        new = len(link)
        longest.append(longest[last] + 1)
        link.append(0)
        follow.append({})
        at = last
        while at >= 0 and c not in follow[at]:
            follow[at][c] = new
            at = link[at]
        if at >= 0:
            to = follow[at][c]
            if longest[to] == longest[at] + 1:
                link[new] = to
            else:
                copy = len(link)
                longest.append(longest[at] + 1)
                link.append(link[to])
                follow.append(follow[to].copy())
                while at >= 0 and follow[at].get(c) == to:
                    follow[at][c] = copy
                    at = link[at]
                link[to] = link[new] = copy
        last = new
        prefix.append(new)
    return link, longest, prefix


class LastEnds:
    """A link-cut tree over the suffix links.  A preferred path is a stretch of
    states with one last end; it is kept as a splay tree by depth, whose top
    holds that end.  Node 0 stands for "none", state s is node s + 1."""

    def __init__(self, link: Sequence[int]):
        n = len(link) + 1
        self.parent = [0] + [x + 1 for x in link]
        self.left, self.right, self.end = [0] * n, [0] * n, [-1] * n

    def _rotate(self, x: int) -> None:
        left, right, parent = self.left, self.right, self.parent
        p = parent[x]
        g = parent[p]
        if left[g] == p:
            left[g] = x
        elif right[g] == p:
            right[g] = x
        if left[p] == x:
            b = left[p] = right[x]
            right[x] = p
        else:
            b = right[p] = left[x]
            left[x] = p
        if b:
            parent[b] = p
        parent[p], parent[x] = x, g

    def _splay(self, x: int) -> None:
        left, right, parent = self.left, self.right, self.parent
        top = x
        while (p := parent[x]) and (left[p] == x or right[p] == x):
            g = parent[p]
            if g and (left[g] == p or right[g] == p):
                top = g
                self._rotate(p if (left[g] == p) == (left[p] == x) else x)
            else:
                top = p
            self._rotate(x)
        self.end[x] = self.end[top]

    def access(self, state: int, new_end: int) -> list[tuple[int, int]]:
        """Recolours the path from ``state`` to the root; (deepest state, old
        end) of each segment that had one."""
        parent, right, ends, seen = self.parent, self.right, self.end, []
        below, x = 0, state + 1
        while x:
            self._splay(x)
            end = ends[x]
            if end >= 0:
                seen.append((x - 1, end))
                if right[x]:
                    ends[right[x]] = end  # the deeper rest keeps its end
            right[x] = below
            below, x = x, parent[x]
        ends[below] = new_end
        return seen


def squares(word: Sequence[int]):
    """(r, p) for squares of period p whose last word is number r, the period of
    every run among them at each of its places from the second period on."""
    link, longest, prefix = suffix_automaton(word)
    tree = LastEnds(link)
    for r, state in enumerate(prefix):
        for deepest, end in tree.access(state, r):
            if r - end <= longest[deepest]:
                yield r, r - end


def extended(word: np.ndarray, r: int, p: int) -> tuple[int, int]:
    """First and one past the last word of the stretch of period ``p`` around
    the square that ends at ``r``."""
    n, size, stop = len(word), 64, r + 1
    while stop < n:
        b = min(n, stop + size)
        differ = word[stop:b] != word[stop - p:b - p]
        if differ.any():
            stop += int(differ.argmax())
            break
        stop, size = b, 2 * size
    start, size = r - 2 * p + 1, 64
    while start > 0:
        a = max(0, start - size)
        differ = (word[a:start] != word[a + p:start + p])[::-1]
        if differ.any():
            start -= int(differ.argmax())
            break
        start, size = a, 2 * size
    return start, stop


def smaller_period(word: np.ndarray, p: int) -> bool:
    """Whether the ``p`` words are a shorter stretch repeated."""
    rest, d = p, 2
    while rest > 1:
        if rest % d:
            d = d + 1 if d * d <= rest else rest
            continue
        while rest % d == 0:
            rest //= d
        step = p // d
        if (word[step:p] == word[:p - step]).all():
            return True
    return False


def stretch_runs(word: np.ndarray, min_length: int, min_exponent: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a stretch of word numbers."""
    covered: dict[int, int] = {}
    out = []
    for r, p in squares(word.tolist()):
        if covered.get(p, -1) > r:
            continue
        start, stop = extended(word, r, p)
        covered[p] = stop
        if stop - start >= max(min_length, min_exponent * p) and not smaller_period(word[start:start + p], p):
            out.append((start, stop - start, p))
    return out


def repeated_stretches(hashes: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Maximal stretches that windows of ``width`` words cover which occur twice."""
    n = len(hashes) - width + 1
    if n < 2:
        return []
    rolled, have = hashes.copy(), 1
    while have < width:  # hashes of have words to those of have + more
        more = min(have, width - have)
        m = len(rolled) - more
        rolled = (rolled[:m] ^ (rolled[:m] >> np.uint64(31))) * np.uint64(_MIX) + rolled[more:more + m]
        have += more
    order = np.sort(rolled)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return []
    at = np.searchsorted(twice, rolled)
    first = np.flatnonzero(twice[np.minimum(at, len(twice) - 1)] == rolled)
    gap = np.flatnonzero(np.diff(first) > width)
    return list(zip(first[np.concatenate([[0], gap + 1])].tolist(),
                    (first[np.concatenate([gap, [len(first) - 1]])] + width).tolist()))


def word_runs(words: Sequence[bytes], min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start and then period."""
    if len(words) < min_length:
        return []
    width = min_length - min_length // 3
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    out = []
    for a, b in repeated_stretches(hashes, width):
        number: dict[bytes, int] = {}
        word = np.array([number.setdefault(w, len(number)) for w in words[a:b]])
        out += [(a + s, n, p) for s, n, p in stretch_runs(word, min_length, min_exponent)]
    return sorted(out, key=lambda x: (x[0], x[2]))


def collapsed(words: Sequence[bytes], runs: Sequence[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that any run holds after its first period."""
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period:start + length] = False
    return [words[k] for k in np.flatnonzero(keep).tolist()]


OUTPUT = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "runs", "collapsed")


def periodic_runs(docs: DataFrame, text: str = "text", min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT,
                  with_spans: bool = False) -> DataFrame:
    """``docs`` less the text, plus ``n_runs``, the run with most periods
    (``start``, ``length``, ``period``, ``exponent_milli``; null without one)
    and digests of the run list and of the words that stay.  ``with_spans`` adds
    ``runs`` (start, length, period) and ``collapsed``, the words that stay."""
    if min_exponent < 3 or min_length < 3:
        raise ValueError("runs of fewer than three periods or words are not found by repeated windows")
    df = without(docs, *(o for o in OUTPUT if o != text.lower()))
    at = [c.lower() for c in df.columns].index(text.lower())
    others = [i for i in range(len(df.columns)) if i != at]
    fields = [*(df.schema.fields[i] for i in others), *(T.StructField(c, T.LongType()) for c in OUTPUT[:5]),
              *(T.StructField(c, T.StringType()) for c in OUTPUT[5:7])]
    span = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
    if with_spans:
        fields += [T.StructField("runs", T.ArrayType(span)), T.StructField("collapsed", T.StringType())]
    schema = T.StructType(fields)

    def run(batches):
        for batch in batches:
            rows = []
            for value in batch.column(at):
                words = value.as_buffer().to_pybytes().split() if value.is_valid else []
                runs = word_runs(words, min_length, min_exponent)
                start, length, period = min(runs, key=_most_periods, default=(None, None, None))
                stay = b" ".join(collapsed(words, runs) if runs else words)
                listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()
                rows.append((len(runs), start, length, period, None if period is None else 1000 * length // period,
                             hashlib.sha256(listed).hexdigest(), hashlib.sha256(stay).hexdigest(),
                             [dict(zip(span.names, r)) for r in runs] if with_spans else None,
                             stay.decode() if with_spans else None))
            columns = list(zip(*rows))[:len(fields) - len(others)] if rows else [[]] * (len(fields) - len(others))
            kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [
                pa.list_(pa.struct([(c, pa.int64()) for c in span.names])), pa.string()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others),
                                              *(pa.array(c, k) for c, k in zip(columns, kinds))], names=schema.names)

    return df.mapInArrow(run, schema)


def _most_periods(run: tuple[int, int, int]):
    """Orders runs by length / period downwards, exactly, then by start and period."""
    start, length, period = run
    return Fraction(-length, period), start, period
