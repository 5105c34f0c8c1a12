"""Freely typed values mapped to the entries of a reference list.

One automaton over all canonical names and aliases finds the mentions in a value; the longest that do not overlap win. A value of
which nothing but words of no meaning is left beside one mention is settled. The others go to token-set similarity: the words of
value and entry are matched as sets, whatever their order and number, where a word stands for another if it is its beginning, if
it is left of it without vowels, or if the words set in the entry's order and read as one are within a number of edits that depends
on the length (so that words may also be run together or torn). If that finds nothing either, a mention that stands alone in the
value still decides; else the value is reported as unmatched. Every distinct value is resolved once.

Candidates come from inverted indexes (pairs of letters, words, beginnings, skeletons), so a value is compared with few entries
however long the list is. A list of more than ``BLOCK`` entries is taken in blocks: each block tells what it finds in a value, and the
findings of all blocks are weighed together, with the same result as from one list.
"""

from __future__ import annotations

import pickle
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from itertools import permutations

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries that are sent to the executors at once.
BLOCK = 20_000
UNMATCHED = "UNMATCHED"
#: Parts into which the rows of a frequent value are spread.
SALTS = 8
# Words around an entry that do not change what it means, and neighbours on a keyboard.
FILLERS = frozenset("the zone zones area side blk block region district sector quarter home house visit visits session sessions appt appointment follow up followup fu x1 x2 x3 1st 2nd 3rd 4th first second third again repeat new pls please service".split())
_ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm")
NEIGHBOURS = frozenset((a, b) for i, row in enumerate(_ROWS) for k, a in enumerate(row) for j, other in enumerate(_ROWS) for m, b in enumerate(other) if abs(i - j) <= 1 and abs(k - m) <= 1 and a != b)


def folded(value: str) -> str:
    """Lower case, without accents, with one blank for each run of other characters than letters and digits."""
    plain = unicodedata.normalize("NFKD", value.casefold())
    plain = regex.sub(r"[\p{M}\p{Cf}]", "", plain)
    return regex.sub(r"[^\p{L}\p{N}]+", " ", plain).strip()


def edits(a: str, b: str, most: float) -> float:
    """Damerau-Levenshtein distance, with letters allowed to come between two that changed places.

    Slips of the hand (neighbouring key, doubled letter, swapped letters) cost a little less than other edits. A value beyond
    ``most`` when it is exceeded.
    """
    if abs(len(a) - len(b)) * 0.9 > most:
        return most + 1
    table = [[float(k) for k in range(len(b) + 1)]]
    seen: dict[str, int] = {}
    for i, x in enumerate(a, 1):
        row, above, match = [float(i)], table[-1], 0
        extra = 0.9 if i > 1 and a[i - 2] == x else 1.0
        for j, y in enumerate(b, 1):
            cost = above[j - 1] + (0.0 if x == y else 0.9 if (x, y) in NEIGHBOURS else 1.0)
            cost = min(cost, above[j] + extra, row[j - 1] + 1.0)
            swapped = seen.get(y, 0)
            if swapped and match:
                cost = min(cost, table[swapped - 1][match - 1] + (i - swapped - 1) + 0.9 + (j - match - 1))
            if x == y:
                match = j
            row.append(cost)
        seen[x] = i
        table.append(row)
    return table[-1][-1]


def allowed(length: int) -> float:
    """Edits within which a text of this length is taken for a misspelling."""
    return 1.0 if length <= 6 else 2.0 if length <= 16 else 3.0


def skeleton(word: str) -> str:
    return word[:1] + regex.sub("[aeiou]", "", word[1:])


def trimmed(tokens: list[str]) -> Iterator[list[str]]:
    """The tokens, then without words of no meaning at their ends, fewest left out first."""
    yield tokens
    lead = next((k for k, t in enumerate(tokens) if t not in FILLERS), len(tokens))
    tail = next((k for k, t in enumerate(reversed(tokens)) if t not in FILLERS), len(tokens))
    cuts = sorted((a + b, a, b) for a in range(lead + 1) for b in range(tail + 1) if 0 < a + b < len(tokens))
    for _, a, b in cuts:
        yield tokens[a : len(tokens) - b]


class Grams:
    """Inverted index of pairs of letters: which of many texts may be within a number of edits of a given one."""

    def __init__(self, texts: list[str]) -> None:
        self.sizes = np.array([len(t) for t in texts], np.int64)
        lists: dict[str, list[int]] = {}
        for k, text in enumerate(texts):
            for gram, n in self.of(text).items():
                for i in range(n):
                    lists.setdefault(f"{gram}{i}", []).append(k)
        self.lists = {g: np.array(ks, np.int32) for g, ks in lists.items()}
        self.by_size: dict[int, np.ndarray] = {int(n): np.flatnonzero(self.sizes == n) for n in np.unique(self.sizes)}

    @staticmethod
    def of(text: str) -> Counter:
        return Counter(a + b for a, b in zip(f"^{text}", f"{text}$", strict=True))

    def near(self, text: str, most: float) -> np.ndarray:
        """Numbers of all texts that may be within ``most`` edits (of 0.9 at least): none of these is left out.

        An edit changes at most two pairs, a swap three, so the texts have all but 3 pairs for each edit in common.
        """
        steps, n = int(most / 0.9 + 1e-9), len(text)
        found = [self.lists[key] for g, m in self.of(text).items() for i in range(m) if (key := f"{g}{i}") in self.lists]
        numbers, shared = np.unique(np.concatenate(found), return_counts=True) if found else (np.empty(0, np.int64), np.empty(0, np.int64))
        sizes = self.sizes[numbers]
        kept = numbers[(np.abs(sizes - n) * 0.9 <= most) & (shared >= np.maximum(sizes, n) + 1 - 3 * steps)]
        # So short that no pair need be shared.
        short = [self.by_size[m] for m in range(max(0, n - steps - 1), 3 * steps) if m in self.by_size and max(m, n) + 1 <= 3 * steps and abs(m - n) * 0.9 <= most]
        return np.unique(np.concatenate([kept, *short])) if short else kept


def one(owners: Iterable[str]) -> str | None:
    held = set(owners)
    return next(iter(held)) if len(held) == 1 else None


class Matcher:
    """What the entries of one field, or a block of them, have to do with a value."""

    def __init__(self, entries: list[tuple[str, list[str]]]) -> None:
        """``entries``: canonical values and their aliases (codes)."""
        import ahocorasick

        self.names = [name for name, _ in entries]
        self.automaton = ahocorasick.Automaton()
        self.words = [tuple(folded(name).split()) for name in self.names]
        self.codes: dict[str, set[str]] = {}
        self.sets: dict[tuple[str, ...], set[str]] = {}
        self.skeletons: dict[str | tuple[str, ...], set[str]] = {}
        patterns: dict[str, set[str]] = {}
        forms: dict[str, set[int]] = {}
        postings: dict[str, list[int]] = {}
        for k, (name, aliases) in enumerate(entries):
            # Run together, words have an order: all orders of few words, and the given one of many.
            orders = list(permutations(self.words[k])) if len(self.words[k]) <= 3 else [self.words[k]]
            for order in orders:
                patterns.setdefault(f" {' '.join(order)} ", set()).add(name)
                forms.setdefault("".join(order), set()).add(k)
            patterns.setdefault(f" {''.join(self.words[k])} ", set()).add(name)
            self.sets.setdefault(tuple(sorted(self.words[k])), set()).add(name)
            for word in set(self.words[k]):
                postings.setdefault(word, []).append(k)
            for alias in aliases:
                if folded(alias):
                    self.codes.setdefault(folded(alias).replace(" ", ""), set()).add(name)
            apart = tuple(folded(w).replace(" ", "") for w in name.split())
            for found in {self.words[k], apart}:
                self.skeletons.setdefault(tuple(sorted(map(skeleton, found))), set()).add(name)
                for order in permutations(found) if len(found) <= 3 else [found]:
                    self.skeletons.setdefault("".join(map(skeleton, order)), set()).add(name)
        for text, owners in patterns.items():
            self.automaton.add_word(text, (len(text), sorted(owners)))
        self.automaton.make_automaton()
        self.forms = list(forms.items())
        self.form_grams = Grams([form for form, _ in self.forms])
        self.vocabulary = sorted(postings)
        self.postings = [np.array(postings[w], np.int32) for w in self.vocabulary]
        self.place = {w: i for i, w in enumerate(self.vocabulary)}
        self.word_grams = Grams(self.vocabulary)

    def mentions(self, text: str) -> list[tuple[int, int, list[str]]]:
        """Where in `` text `` (with a blank around it) which entries are mentioned, overlapping or not."""
        return [(end - length + 1, end + 1, owners) for end, (length, owners) in self.automaton.iter(f" {text} ")] if self.names else []

    def similar(self, tokens: list[str]) -> tuple[set[str], dict[str, float]]:
        """Owners of the code that the tokens are, and the entries whose set of words they stand for, with their distance."""
        text = "".join(tokens)
        if not text:
            return set(), {}
        if text in self.codes:
            return self.codes[text], {}
        ranked: dict[str, float] = {}

        def rank(name: str, distance: float) -> None:
            ranked[name] = min(distance, ranked.get(name, 9.0))

        for name in self.sets.get(tuple(sorted(tokens)), ()):
            rank(name, 0.0)
        most = allowed(len(text) + 1)
        for k in self.form_grams.near(text, most):
            form, owners = self.forms[k]
            limit = min(allowed(len(form)), most)
            if (d := edits(text, form, limit)) <= limit:
                for owner in owners:
                    rank(self.names[owner], d)
        for k in self.of_like_words(tokens):
            form = "".join(self.words[k])
            limit = min(allowed(len(form)), most)
            if (d := edits("".join(self.in_order(tokens, self.words[k])), form, limit)) <= limit:
                rank(self.names[k], d)
        for key in (text, tuple(sorted(tokens))):
            for name in self.skeletons.get(key, ()):
                rank(name, 0.85)
        for k in self.begun_by(tokens):
            rank(self.names[k], 0.5 if len(text) >= 4 else 0.95)
        return set(), ranked

    def of_like_words(self, tokens: list[str]) -> list[int]:
        """Entries of more than three words that share half of their words with the tokens, spelt alike or nearly."""
        if len(tokens) <= 2:
            return []
        votes: Counter = Counter()
        for token in set(tokens):
            near = {self.place[token]} if token in self.place else set(self.word_grams.near(token, allowed(len(token))).tolist())
            votes.update({int(k) for w in near for k in self.postings[w] if len(self.words[k]) > 3})
        return [k for k, n in votes.items() if 2 * n >= len(set(self.words[k])) and 2 * n >= len(set(tokens))]

    @staticmethod
    def in_order(tokens: list[str], words: tuple[str, ...]) -> list[str]:
        """The tokens in the order of the words they are nearest to, equal ones first."""
        left, placed = list(tokens), []
        for exact in (True, False):
            for i, w in enumerate(words):
                if any(i == j for j, _ in placed) or not left:
                    continue
                best = min(left, key=lambda t: (t != w, edits(t, w, 3.0)))
                if best == w or not exact:
                    placed.append((i, best))
                    left.remove(best)
        return [t for _, t in sorted(placed)] + left

    def begun_by(self, tokens: list[str]) -> list[int]:
        """Entries of as many words, each begun by another token of two letters or more (or of which it is all)."""
        if len("".join(tokens)) < 3 or not tokens:
            return []
        ranges = [(bisect_left(self.vocabulary, t), bisect_left(self.vocabulary, t + "\U0010ffff")) for t in tokens]
        if any(a == b for a, b in ranges):
            return []
        a, b = min(ranges, key=lambda r: r[1] - r[0])
        near = {int(k) for w in range(a, b) for k in self.postings[w]}
        return [k for k in near if len(self.words[k]) == len(tokens) and self.shortened(tokens, self.words[k])]

    @staticmethod
    def shortened(tokens: list[str], words: tuple[str, ...]) -> bool:
        """Whether each token is the beginning, of two letters or more, of another word, by a matching of tokens and words."""
        fits = [[j for j, w in enumerate(words) if w.startswith(t) and (len(t) >= 2 or t == w)] for t in tokens]
        taken: dict[int, int] = {}

        def settle(k: int, tried: set[int]) -> bool:
            for j in fits[k]:
                if j not in tried:
                    tried.add(j)
                    if j not in taken or settle(taken[j], tried):
                        taken[j] = k
                        return True
            return False

        return all(settle(k, set()) for k in range(len(tokens)))

    def findings(self, value: str) -> tuple:
        """All that this block has to say about a value, for ``decide``."""
        text = folded(value)
        return self.codes.get(text.replace(" ", ""), set()), self.mentions(text), [self.similar(kept) for kept in trimmed(text.split())]

    def resolve(self, value: str) -> str:
        text = folded(value)
        variants = list(trimmed(text.split()))
        return decide(text, self.codes.get(text.replace(" ", ""), set()), self.mentions(text), len(variants), lambda k: self.similar(variants[k]))


def decide(text: str, coded: set[str], found: list[tuple[int, int, list[str]]], variants: int, similar: Callable[[int], tuple[set[str], dict[str, float]]]) -> str:
    """The entry that a folded value means: by the longest mentions, by its code, by similarity, at last by a mention alone."""
    taken: list[tuple[int, int, set[str]]] = []
    for a, b, owners in sorted(found, key=lambda x: (x[0] - x[1], x[0])):
        held = next((o for x, y, o in taken if (x, y) == (a, b)), None)
        if held is not None:
            held |= set(owners)
        elif all(b - 1 <= x or a >= y - 1 for x, y, _ in taken):
            taken.append((a, b, set(owners)))
    rest = list(f" {text} ")
    for a, b, _ in taken:
        rest[a + 1 : b - 1] = " " * (b - a - 2)
    whole = {name for *_, owners in taken for name in owners}
    if len(whole) == 1 and all(t in FILLERS for t in "".join(rest).split()):
        return next(iter(whole))
    if (code := one(coded)) is not None:
        return code
    for k in range(variants):
        codes, ranked = similar(k)
        if (code := one(codes)) is not None:
            return code
        if ranked and (best := one(name for name, d in ranked.items() if d == min(ranked.values()))) is not None:
            return best
    return one(whole) or UNMATCHED


def together(value: str, findings: list[tuple]) -> str:
    """What a value means by the findings of all blocks."""
    def similar(k: int) -> tuple[set[str], dict[str, float]]:
        codes = set().union(*[f[2][k][0] for f in findings])
        return codes, {} if codes else {name: d for f in findings for name, d in f[2][k][1].items()}

    return decide(folded(value), set().union(*[f[0] for f in findings]), [m for f in findings for m in f[1]], len(findings[0][2]), similar)


def _resolver(reference, finding: bool):
    def resolve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matchers = {field: Matcher(entries) for field, entries in reference.value.items()}
        for frame in frames:
            pairs = list(zip(frame["_field"], frame["_value"], strict=True))
            if finding:
                yield frame.assign(_found=[pickle.dumps(matchers[f].findings(v)) if f in matchers else None for f, v in pairs])
            else:
                yield frame.assign(_canonical=[matchers[f].resolve(v) if f in matchers else UNMATCHED for f, v in pairs])

    return resolve


def _weigh(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        meant = [together(v, [pickle.loads(x) for x in found if x is not None]) if any(x is not None for x in found) else UNMATCHED for v, found in zip(frame["_value"], frame["_all"], strict=True)]
        yield frame[["_field", "_value"]].assign(_canonical=meant)


def map_values(values: DataFrame, row_id: str, field: str, value: str, reference: DataFrame, ref_field: str, ref_value: str, ref_code: str | None = None, block: int = BLOCK) -> DataFrame:
    """Typed values and what they mean: row_id, field, canonical ('UNMATCHED' if no entry is meant).

    One row for each row of ``values`` whose field is not null and whose value is neither null nor blank nor exactly an entry of
    its field. Values of a field that ``reference`` does not know are unmatched. Values that fit several entries equally well are
    unmatched. Rows that repeat give equal results; empty tables give no rows. ``reference`` may be of any length; about ``block`` of
    its rows at a time are collected and sent to the executors.
    """
    entries = reference.select(F.col(f"`{ref_field}`").cast("string").alias("_field"), F.col(f"`{ref_value}`").cast("string").alias("_value"), (F.col(f"`{ref_code}`") if ref_code else F.lit(None)).cast("string").alias("_code")).where("_field is not null and _value is not null")
    typed = values.select(F.col(f"`{row_id}`").alias("_id"), F.col(f"`{field}`").cast("string").alias("_field"), F.col(f"`{value}`").cast("string").alias("_value"))
    typed = typed.where(F.regexp_replace("_value", r"[\s\p{Z}]+", "") != "")
    typed = typed.join(entries.select("_field", "_value").distinct(), ["_field", "_value"], "left_anti")
    distinct = typed.select("_field", "_value").distinct()
    blocks = entries.count() // block + 1
    found = []
    for k in range(blocks):
        # An entry with all its codes is in one block.
        part = entries if blocks == 1 else entries.where(F.pmod(F.xxhash64("_field", "_value"), F.lit(blocks)) == k)
        lists: dict[str, dict[str, list[str]]] = {}
        for name, entry, code in sorted(map(tuple, part.collect()), key=str):
            lists.setdefault(name, {}).setdefault(entry, []).extend([code] if code else [])
        shared = values.sparkSession.sparkContext.broadcast({name: sorted(held.items()) for name, held in lists.items()})
        found.append(distinct.mapInPandas(_resolver(shared, blocks > 1), "_field string, _value string, " + ("_found binary" if blocks > 1 else "_canonical string")))
    resolved = found[0]
    if blocks > 1:  # as many findings for a value as there are blocks
        told = reduce(DataFrame.unionAll, found).groupBy("_field", "_value").agg(F.collect_list("_found").alias("_all"))
        resolved = told.mapInPandas(_weigh, "_field string, _value string, _canonical string")
    salted = resolved.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = typed.withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(SALTS)).cast("int")).join(salted, ["_field", "_value", "_salt"])
    return joined.select(F.col("_id").alias(row_id), F.col("_field").alias("field"), F.col("_canonical").alias("canonical"))
