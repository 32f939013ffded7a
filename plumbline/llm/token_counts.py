"""Exact token counts of a byte-level BPE by prefix dynamic programming.

A byte-level BPE encodes every prefix of a word with exactly one token
sequence, and a sequence is an encoding if and only if each two neighbours
are one.  So the last token of every prefix follows from the last tokens of
shorter prefixes: it is the token that ends there and is compatible with the
last token before it.  One pass over a word gives its count at every prefix;
a text's count at a prefix is the count of the words before plus that of the
word's own prefix.  Truncation ("the longest prefix within a budget") and
budget questions are answered from these counts; nothing is encoded again.

Word vectors are kept in each Python worker in a bounded memo.  The
vocabulary is read on the driver from a path that is a parameter and is
broadcast (a file of fixed size).

Defined cases: null is the empty text, 0 bytes and 0 tokens; special tokens'
strings inside a text are one token, as is the library's default; repeated
rows give repeated rows; only the id and text columns are looked at.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from plumbline.llm.common import read

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 512
#: Words of each worker's memo in each of its two generations.
MEMO = 700_000
#: Words whose whole prefix vector is kept; beyond, they start anew.
VECTORS = 100_000
#: Remembered pairs of tokens; beyond, they start anew.
PAIRS = 1_500_000

WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Where the installed ``regex`` and the tokenizer library hold the same Unicode classes.
_SAME_CLASSES = regex.compile("[\\x00-՗ೝ-₎₠-ꟍ]*")
_LATIN_END = 0x250


def _latin_words() -> re.Pattern:
    """WORDS for texts below U+0250, with the classes spelt out for the faster ``re``."""
    chars = [chr(c) for c in range(_LATIN_END)]
    letter, number, space = ("".join(re.escape(c) for c in chars if regex.match(k, c)) for k in (r"\p{L}", r"\p{N}", r"\s"))
    return re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")


_LATIN_WORDS = _latin_words()
_LATIN = re.compile("[\\x00-ɏ]*")
_CONTRACTIONS = {"'re", "'ve", "'ll"}


def _byte_letters() -> dict[str, int]:
    """The public byte-level alphabet: printable bytes stand for themselves, others for U+0100 and up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


class PrefixCounter:
    """Token counts of texts and of all their prefixes."""

    def __init__(self, vocabulary: bytes):
        spec = json.loads(vocabulary)
        letter = _byte_letters()
        raw = lambda s: bytes(letter[c] for c in s)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.special = [t["content"] for t in spec.get("added_tokens", []) if t.get("special")]
        self._cut = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.ids = {raw(w): n for w, n in spec["model"]["vocab"].items() if w not in self.special}
        self.token = {n: w for w, n in self.ids.items()}
        self.rank: dict[int, int] = {}
        made: dict[int, tuple[int, int, int]] = {}
        for n, (a, b) in enumerate(merges):
            x, y = self.ids[raw(a)], self.ids[raw(b)]
            self.rank[x << 32 | y] = n
            made.setdefault(self.ids[raw(a) + raw(b)], (n, x, y))
        # the pieces at a token's edge in the order of their merges, each with the rank of the merge that ends it
        never = len(merges)
        self.right = {t: self._edge(t, made, 2, never) for t in self.token}
        self.left = {t: self._edge(t, made, 1, never) for t in self.token}
        self.longest = max(map(len, self.ids))
        self._fits: dict[int, bool] = {}
        self._library = None
        self.totals = _Memo(self)
        self.vectors: dict[str, list[int]] = {}

    @staticmethod
    def _edge(token: int, made: dict, side: int, never: int) -> list[tuple[int, int]]:
        edge, ends = [], never
        while True:
            edge.append((token, ends))
            if token not in made:
                return edge[::-1]
            ends, token = made[token][0], made[token][side]

    def _fit(self, a: int, b: int) -> bool:
        """Whether token b may follow token a: no merge across the border comes before those that build a and b."""
        key = a << 32 | b
        if (found := self._fits.get(key)) is None:
            if len(self._fits) >= PAIRS:
                self._fits.clear()
            found = self._fits[key] = self._apart(self.right[a], self.left[b])
        return found

    def _apart(self, right: list[tuple[int, int]], left: list[tuple[int, int]]) -> bool:
        i = j = 0
        while True:
            (x, ends_x), (y, ends_y) = right[i], left[j]
            across = self.rank.get(x << 32 | y)
            if across is not None and across < ends_x and across <= ends_y:
                return False
            if i == len(right) - 1 and j == len(left) - 1:
                return True
            if ends_x <= ends_y:  # of equal merges the left one comes first
                i += 1
            else:
                j += 1

    def byte_prefixes(self, word: bytes) -> list[int]:
        """Counts of word[:1], word[:2], ...; prefixes that end inside a character count their bytes."""
        last, count, get, fits, merges, longest = [0], [0], self.ids.get, self._fits, self.rank, self.longest
        for i in range(1, len(word) + 1):
            t = get(word[:i]) if i <= longest else None
            if t is not None:  # a token is its own encoding
                last.append(t)
                count.append(1)
                continue
            for j in range(max(1, i - longest), i):
                t = get(word[j:i])
                if t is None:
                    continue
                key = last[j] << 32 | t
                if key in merges:  # the two would be one
                    continue
                ok = fits.get(key)
                if ok is None:
                    ok = self._fit(last[j], t)
                if ok:
                    last.append(t)
                    count.append(count[j] + 1)
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")
        return count[1:]

    def word_prefixes(self, word: str) -> list[int]:
        """Counts at every character of one word, each prefix as a text of its own; the vectors are kept."""
        if (found := self.vectors.get(word)) is None:
            found = self._word_prefixes(word)
            if len(word) <= 64:
                if len(self.vectors) >= VECTORS:
                    self.vectors.clear()
                self.vectors[word] = found
        return found

    def _word_prefixes(self, word: str) -> list[int]:
        counts = self.byte_prefixes(word.encode())
        if not word.isascii():
            counts = [counts[e - 1] for e in np.cumsum([len(c.encode()) for c in word]).tolist()]
        if word in _CONTRACTIONS:  # "'r" is two words, "'re" is one
            counts[1] = 2
        return counts

    def words(self, text: str) -> list[str]:
        if text.isascii() or _LATIN.fullmatch(text):
            return _LATIN_WORDS.findall(text)
        if _SAME_CLASSES.fullmatch(text):
            return WORDS.findall(text)
        if self._library is None:
            from tokenizers import pre_tokenizers

            self._library = pre_tokenizers.ByteLevel(add_prefix_space=False)
        return [text[a:b] for _, (a, b) in self._library.pre_tokenize_str(text)]

    def count(self, text: str) -> int:
        """Tokens of the whole text: the count at its last prefix."""
        if self._cut is None or self.special[0][:2] not in text:
            return sum(map(self.totals.__getitem__, self.words(text)))
        parts = self._cut.split(text)
        return len(parts) - 1 + sum(sum(map(self.totals.__getitem__, self.words(p))) for p in parts)

    def prefixes(self, text: str) -> np.ndarray:
        """Counts at every character prefix of the text."""
        out, at, base = np.zeros(len(text), np.int32), 0, 0
        cuts = [*self._cut.finditer(text)] if self._cut else []
        for cut in [*cuts, None]:
            end = cut.start() if cut else len(text)
            segment = text[at:end]
            place, before, run, run_base = at, base, "", base
            for w in self.words(segment):
                if w.isspace() or (run and w[0].isspace()):
                    if not run:
                        run_base = before
                    head = w if w.isspace() else w[0]
                    # a prefix that ends in white space ends in one run of it
                    tail = self.word_prefixes(run + head)[len(run) :]
                    out[place : place + len(head)] = np.add(tail, run_base)
                    if len(head) < len(w):
                        out[place + 1 : place + len(w)] = np.add(self.word_prefixes(w)[1:], before)
                        run = ""
                    else:
                        run += w
                else:
                    out[place : place + len(w)] = np.add(self.word_prefixes(w), before)
                    run = ""
                before += self.totals[w]
                place += len(w)
            if cut:  # inside the special string it is still ordinary text
                for k in range(1, len(cut[0])):
                    out[end + k - 1] = base + sum(map(self.totals.__getitem__, self.words(segment + cut[0][:k])))
                before += 1
                out[cut.end() - 1] = before
                at = cut.end()
            base = before
        return out

    def longest_within(self, text: str, budget: int) -> int:
        """Characters of the longest prefix of at most ``budget`` tokens."""
        within = np.flatnonzero(self.prefixes(text) <= budget)
        return int(within[-1]) + 1 if len(within) else 0


class _Memo(dict):
    """A word's count, from its prefix vector.  When full, the words become the older generation, from which
    those in use come back."""

    def __init__(self, counter: PrefixCounter):
        super().__init__()
        self.counter, self.older = counter, {}

    def __missing__(self, word: str) -> int:
        n = self.older.get(word)
        if n is None:
            n = self.counter.byte_prefixes(word.encode())[-1]
        if len(word) <= 64:
            if len(self) >= MEMO:
                self.older = dict(self)
                self.clear()
            self[word] = n
        return n


_counters: dict[int, PrefixCounter] = {}


def _counter(vocabulary) -> PrefixCounter:
    """One counter for each worker process."""
    raw = vocabulary.value
    key = hash(raw)
    if key not in _counters:
        _counters.clear()
        _counters[key] = PrefixCounter(raw)
    return _counters[key]


def vocabulary_file(path: str | None = None) -> bytes:
    """The vocabulary's bytes, read on the driver."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    with open(path, "rb") as f:
        return f.read()


def token_counts(docs: DataFrame, *, limit: int = LIMIT, path: str | None = None, with_prefixes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit and kept_chars (of the longest prefix within the limit; for a text
    within the limit all of it); with_prefixes adds prefix_tokens, the count at every character."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(vocabulary_file(path))

    def run(batches):
        counter = _counter(vocabulary)
        for batch in batches:
            texts = ["" if t is None else t for t in batch.column(1).to_pylist()]
            totals = [counter.count(t) for t in texts]
            kept = [len(t) if n <= limit else _kept(counter, t, limit) for t, n in zip(texts, totals, strict=True)]
            columns = [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(totals, pa.int64()), pa.array([n > limit for n in totals], pa.bool_()), pa.array(kept, pa.int64())]
            names = ["doc_id", "n_bytes", "n_tokens", "over_limit", "kept_chars"]
            if with_prefixes:
                columns.append(pa.array([counter.prefixes(t).tolist() for t in texts], pa.list_(pa.int32())))
                names.append("prefix_tokens")
            yield pa.RecordBatch.from_arrays(columns, names)

    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, n_bytes bigint, n_tokens bigint, over_limit boolean, kept_chars bigint" + ", prefix_tokens array<int>" * with_prefixes
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _kept(counter: PrefixCounter, text: str, limit: int) -> int:
    """As longest_within, from the counts at word ends and the vector of the word in which the budget ends."""
    if counter._cut is not None and counter.special[0][:2] in text and counter._cut.search(text):
        return counter.longest_within(text, limit)
    # counts at word ends never fall; a run of white space is read as one, so the vector begins before it
    place = before = start = base = 0
    for w in counter.words(text):
        if not place or not text[place - 1].isspace():
            start, base = place, before
        after = before + counter.totals[w]
        if after > limit:
            break
        place, before = place + len(w), after
    counts = counter.prefixes(text[start : place + len(w) + 1]) + base
    within = np.flatnonzero(counts <= limit)
    return start + int(within[-1]) + 1 if len(within) else start


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"))


QUERIES = {"op3_token_counts": op3_token_counts}
SQL: dict[str, str] = {}
