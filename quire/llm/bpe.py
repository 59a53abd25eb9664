"""Byte-pair encoding by speculation: greedy longest match, checked pair by pair.

For each distinct word a greedy longest match proposes tokens. A proposal is
the byte-pair encoding if every token encodes to itself and every adjacent pair
of tokens, put together, encodes to just that pair. Pairs are checked all at
once against a sorted table of known verdicts; a pair that is new is merged
exactly once and remembered. Only words with an incompatible pair are merged
exactly. Words repeat, so pieces between white space are kept in a bounded
cache.

The vocabulary is a tokenizers file whose model is BPE with an end-of-word
suffix, normalised by NFC and lower case, split by pattern and mapped to byte
characters. Decoding joins the token strings with spaces, as the file has no
decoder.

Null or empty text: no tokens. Null doc_id: a value like others. Special tokens in
a text become their ids. Repeated rows are encoded each, alike. Very long texts
are encoded whole, in a block of their own, and a very long word by merging with
a heap. Extra columns are ignored unless carried. An empty table gives an empty
result.
"""

from __future__ import annotations

import heapq
import json
import sys
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm._text import blocks, text_bytes

MOST_PIECES = 150_000
LITTLE = sys.byteorder == "little" and array("I").itemsize == 4
MOST_PAIRS = 2_000_000


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself if it prints, else one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(spare)) for b in range(256)]


class SpeculativeBpe:
    """Encoder and decoder for one vocabulary file's text."""

    def __init__(self, source: str) -> None:
        spec = json.loads(source)
        model = spec["model"]
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or not split["invert"] or spec["decoder"]:
            raise ValueError("not a vocabulary of the supported kind")
        self.suffix = model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = model["vocab"]
        specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = {k: np.uint32(v).astype("<u4").tobytes() for k, v in specials.items()}
        self.special_at = regex.compile("|".join(regex.escape(s) for s in sorted(specials, key=len, reverse=True))) if specials else None
        self.size = max([*self.ids.values(), *specials.values()]) + 1
        self.token = [""] * self.size
        for token, number in [*self.ids.items(), *specials.items()]:
            self.token[number] = token
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank = {self.ids[x] * self.size + self.ids[y]: k for k, (x, y) in enumerate(pairs)}
        self.made = [self.ids[x + y] for x, y in pairs]
        self.longest = max(map(len, self.ids))
        self.words = regex.compile(split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))
        character = byte_characters()
        self.translate = {b: c for b, c in enumerate(character) if chr(b) != c}
        self.symbol = {c: self.ids.get(c, -1) for c in character}
        self.last_symbol = {c: self.ids.get(c + self.suffix, -1) for c in character}
        self.alone: dict[int, bool] = {}
        self.pair_codes, self.pair_ok = np.zeros(0, np.int64), np.zeros(0, bool)
        self.known: dict[str, list[int]] = {}
        self.pieces: dict[str, bytes] = {}
        self.strings: dict[str, str] = {}
        self.aged: tuple[dict[str, bytes], dict[str, str]] = ({}, {})
        self.checked = self.merged = 0

    def spell(self, word: str) -> str:
        """The byte characters of a word."""
        return word.encode().decode("latin-1").translate(self.translate)

    def symbols(self, chars: str) -> list[int]:
        """Symbol of each byte character, the last with the suffix; one without an entry is dropped, as the library does."""
        found = [self.symbol[c] for c in chars[:-1]]
        found.append(self.last_symbol[chars[-1]])
        return [x for x in found if x >= 0] if -1 in found else found

    def token_symbols(self, token: int) -> list[int]:
        text = self.token[token]
        if self.suffix and text.endswith(self.suffix) and text != self.suffix:
            return self.symbols(text[: -len(self.suffix)])
        return [self.symbol[c] for c in text]

    def merge(self, parts: list[int]) -> list[int]:
        """Exact merging: always the pair of least rank, leftmost first."""
        if len(parts) > 256:
            return self._merge_long(parts)
        size, rank, none = self.size, self.rank.get, len(self.made)
        parts = list(parts)
        ranks = [rank(a * size + b, none) for a, b in zip(parts, parts[1:])]  # noqa: B905
        while ranks and (least := min(ranks)) < none:
            i = ranks.index(least)
            parts[i : i + 2] = [self.made[least]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank(parts[i - 1] * size + parts[i], none)
            if i < len(ranks):
                ranks[i] = rank(parts[i] * size + parts[i + 1], none)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        """The same for a long word, with a heap and links between neighbours."""
        n, size, rank, parts = len(parts), self.size, self.rank, list(parts)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i) for i in range(n - 1) if (r := rank.get(parts[i] * size + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = right[i] if parts[i] >= 0 else -1
            if j < 0 or rank.get(parts[i] * size + parts[j]) != r:
                continue
            parts[i], parts[j], right[i] = self.made[r], -1, right[j]
            for a, b in ((left[i], i), (i, right[i])):
                if a >= 0 and b >= 0 and (k := rank.get(parts[a] * size + parts[b])) is not None:
                    heapq.heappush(heap, (k, a))
            if right[i] >= 0:
                left[right[i]] = i
        return [x for x in parts if x >= 0]

    def propose(self, word: str) -> list[int]:
        """Longest vocabulary entries from the left."""
        ids, n, at, out = self.ids.get, len(word), 0, []
        ended, alone, longest = word + self.suffix, self.alone.get, self.longest
        while at < n:
            token = ids(ended[at:]) if n - at <= longest else None
            if token is not None and (alone(token) or self.itself(token)):
                out.append(token)
                break
            for end in range(min(n - 1, at + longest), at, -1):
                token = ids(word[at:end])
                if token is not None and (alone(token) or self.itself(token)):
                    out.append(token)
                    break
            else:
                end = at + 1
            at = end
        return out

    def itself(self, token: int) -> bool:
        if (ok := self.alone.get(token)) is None:
            ok = self.alone[token] = self.merge(self.token_symbols(token)) == [token]
        return ok

    def compatible(self, codes: np.ndarray) -> np.ndarray:
        """Verdict for each pair left * size + right."""
        distinct, back = np.unique(codes, return_inverse=True)
        at = np.searchsorted(self.pair_codes, distinct)
        old = at < len(self.pair_codes)
        old[old] = self.pair_codes[at[old]] == distinct[old]
        ok = np.zeros(len(distinct), bool)
        ok[old] = self.pair_ok[at[old]]
        new = distinct[~old]
        if len(new):
            fine = []
            for c in new.tolist():
                a, b = divmod(c, self.size)
                fine.append(self.merge(self.token_symbols(a) + self.token_symbols(b)) == [a, b])
            ok[~old] = fine
            if len(self.pair_codes) > MOST_PAIRS:
                self.pair_codes, self.pair_ok = np.zeros(0, np.int64), np.zeros(0, bool)
                new, fine = distinct, ok
            every, verdicts = np.concatenate([self.pair_codes, new]), np.concatenate([self.pair_ok, fine])
            order = np.argsort(every, kind="stable")
            self.pair_codes, self.pair_ok = every[order], verdicts[order]
        return ok[back]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Token ids of each distinct word, given in byte characters."""
        proposals = [self.propose(w) for w in words]
        count = np.array([len(p) for p in proposals], np.int64)
        flat = np.array([t for p in proposals for t in p], np.int64)
        word = np.repeat(np.arange(len(words)), count)
        inner = np.flatnonzero(word[1:] == word[:-1]) if len(word) else np.zeros(0, np.int64)
        fine = self.compatible(flat[inner] * self.size + flat[inner + 1]) if len(inner) else np.zeros(0, bool)
        self.checked += len(words)
        failing = np.unique(word[inner[~fine]]).tolist()
        self.merged += len(failing)
        for k in failing:
            proposals[k] = self.merge(self.symbols(words[k]))
        return proposals

    def learn(self, pieces: Iterable[str]) -> None:
        """Put new pieces, which hold no white space, into the cache."""
        new = list(pieces)
        if len(self.known) > MOST_PIECES:
            self.known.clear()
        find, known, token = self.words.findall, self.known, self.token
        parts = [[p] if p.isalpha() and p.isascii() else find(p) for p in new]
        distinct = [w for w in dict.fromkeys(w for p in parts for w in p) if w not in known]
        known.update(zip(distinct, self.encode_words([self.spell(w) for w in distinct]), strict=True))
        for piece, words in zip(new, parts, strict=True):
            found = known[words[0]] if len(words) == 1 else [t for w in words for t in known[w]]
            self.pieces[piece] = array("I", found).tobytes() if LITTLE else np.array(found, "<u4").tobytes()
            self.strings[piece] = " ".join([token[t] for t in found])

    def normal(self, text: str) -> str:
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower()  # a capital sigma alone would fold by its place in the word

    @staticmethod
    def split(text: str) -> list[str]:
        """Pieces between white space; str.split() alone takes four control characters for white space too."""
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return regex.split(r"\p{White_Space}+", text)
        return text.split()

    def encode(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """(ids as little-endian unsigned 32-bit integers, decoded text) of each text."""
        split = []
        for text in texts:
            segments, at = [], 0
            if self.special_at:
                for m in self.special_at.finditer(text) if "<" in text else ():
                    segments += [self.split(self.normal(text[at : m.start()])), m[0]]
                    at = m.end()
            split.append([*segments, self.split(self.normal(text[at:]))])
        known = self.pieces
        missing = {p for segments in split for s in segments if isinstance(s, list) for p in s if p not in known}
        if missing:
            if len(known) > MOST_PIECES:  # what is in use again is taken over from the older cache
                self.aged, self.pieces, self.strings = (self.pieces, self.strings), {}, {}
                missing = {p for segments in split for s in segments if isinstance(s, list) for p in s}
            old, old_strings = self.aged
            again = [p for p in missing if p in old]
            self.pieces.update((p, old[p]) for p in again)
            self.strings.update((p, old_strings[p]) for p in again)
            self.learn(missing.difference(again))
        known, strings = self.pieces, self.strings
        out = []
        for segments in split:
            ids, text = [], []
            for s in segments:
                if isinstance(s, str):
                    ids.append(self.special[s])
                    text.append(s)
                else:
                    ids.append(b"".join([known[p] for p in s]))
                    text.append(" ".join([x for p in s if (x := strings[p])]))
            out.append((b"".join(ids), " ".join([x for x in text if x])))
        return out


_ENCODERS: dict[int, SpeculativeBpe] = {}


def encoder(source: str) -> SpeculativeBpe:
    """One encoder for each vocabulary in this process, so that its cache lasts from task to task."""
    key = hash(source)
    if key not in _ENCODERS:
        _ENCODERS[key] = SpeculativeBpe(source)
    return _ENCODERS[key]


def encode_batches(batches: Iterable[pa.RecordBatch], source: str) -> Iterator[tuple[pa.RecordBatch, list[tuple[bytes, str]]]]:
    """Slices of the batches with what their `text` column encodes to."""
    bpe = encoder(source)
    for batch in batches:
        _, offs = text_bytes(batch["text"])
        for lo, hi in blocks(offs):
            part = batch.slice(lo, hi - lo)
            yield part, bpe.encode([t or "" for t in part["text"].to_pylist()])


def bpe(docs: DataFrame, vocabulary: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit), decoded, and the columns `carry`. vocabulary: path of the file on the driver."""
    spark = docs.sparkSession
    source = spark.sparkContext.broadcast(Path(vocabulary).read_text(encoding="utf-8"))  # a few megabytes, whatever the corpus
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(F.col(c).alias(f"__carry{k}") for k, c in enumerate(carry)))
    kinds = docs.select(*carry).schema

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in encode_batches(batches, source.value):
            columns = [part["doc_id"], pa.array([len(ids) // 4 for ids, _ in found], pa.int64()), pa.array([ids for ids, _ in found], pa.binary()), pa.array([text for _, text in found], pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, *(part[f"__carry{k}"] for k in range(len(carry)))], ["doc_id", "n_tokens", "ids", "decoded", *(f"__carry{k}" for k in range(len(carry)))])

    out = base.mapInArrow(work, ", ".join(["doc_id long, n_tokens long, ids binary, decoded string", *(f"__carry{k} {f.dataType.simpleString()}" for k, f in enumerate(kinds))]))
    return out.withColumnsRenamed({f"__carry{k}": c for k, c in enumerate(carry)})
