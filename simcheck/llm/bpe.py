"""BPE encoding by backtracking over longest matches, decoding by an offset table.

The vocabulary is one of byte-level symbols whose last symbol of a word carries
an end mark.  A sequence of tokens is the merge result of a word exactly when
every neighbouring pair of tokens is *compatible*: merging the pair's symbols
gives back the pair.  So a word is encoded from left to right with the longest
token that an Aho-Corasick automaton finds at the current place and that is
compatible with the token before it; where nothing fits, the last token is
taken back and a shorter one is tried.  The tokens in front of a place are
unique, so a place that failed once is never tried again and the work is linear
in the matches.  Pair checks are kept in a table as they are met.

Decoding gathers token strings from one byte array through an offset table.

Every task encodes its own documents; the vocabulary file is read on the
driver, sent as a broadcast of its fixed size, and never copied elsewhere.
Tables of words and pairs in a worker are caches with a bound and change no
result.

Defined results: a null or empty text has no tokens and decodes to an empty
text; special tokens that stand in a text are that token; repeated rows are
encoded each; very long words and texts are encoded whole; an empty table
gives no rows; columns beside doc_id and text are dropped.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

END = 0x1000           # added to the code of a word's last symbol
CACHED_WORDS = 200_000
CACHED_PAIRS = 300_000
DECODE_STEP = 1 << 16
ROWS_OUT = 512

# Fixed values of the tokenizer's pre-tokenization: contractions, letters, one
# number character, everything else.  White space only separates.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CONTRACTIONS = r"'s|'t|'re|'ve|'m|'ll|'d"
ASCII_WORDS = re.compile(CONTRACTIONS + r"|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
WORDS = regex.compile(CONTRACTIONS + rf"|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+", regex.V0)


def byte_symbols() -> list[str]:
    """A printable character for every byte: itself if it is one, else one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Bpe:
    def __init__(self, spec: bytes | str):
        data = json.loads(spec)
        model, suffix = data["model"], data["model"]["end_of_word_suffix"]
        vocab: dict[str, int] = model["vocab"]
        self.symbols = byte_symbols()
        self.base: dict[str, int] = {}
        self.spelling: dict[int, str] = {}
        for c in self.symbols:
            for name, inner in ((c, c), (c + suffix, chr(ord(c) + END))):
                self.base[inner] = vocab[name]
                self.spelling[vocab[name]] = inner
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(m.split(" ") if isinstance(m, str) else m for m in model["merges"]):
            left, right, made = vocab[a], vocab[b], vocab[a + b]
            self.merges.setdefault((left, right), (rank, made))
            self.spelling[made] = self.spelling[left] + self.spelling[right]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.special_pattern = re.compile(
            "(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.automaton = ahocorasick.Automaton()
        self.whole: dict[str, int] = {}
        for token, inner in self.spelling.items():
            if self.merge(inner) == [token]:
                self.automaton.add_word(inner, token)
                self.whole[inner] = token
        self.automaton.make_automaton()
        self.length = {t: len(s) for t, s in self.spelling.items()}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.words = _Words(self)
        self._decoding_table({**vocab, **self.special})

    # --- encoding ------------------------------------------------------------
    def merge(self, inner: str) -> list[int]:
        """Merge symbols in rank order, the leftmost of equal ranks first."""
        ids = [self.base[c] for c in inner]
        while len(ids) > 1:
            found = [(m[0], i, m[1]) for i in range(len(ids) - 1) if (m := self.merges.get((ids[i], ids[i + 1])))]
            if not found:
                break
            _, i, made = min(found)
            ids[i:i + 2] = [made]
        return ids

    def compatible(self, a: int, b: int) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= CACHED_PAIRS:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merge(self.spelling[a] + self.spelling[b]) == [a, b]
        return known

    def encode_word(self, word: str) -> list[int]:
        """Tokens of one pre-tokenized word."""
        symbols = self.symbols
        inner = "".join([symbols[b] for b in word.encode()])
        inner = inner[:-1] + chr(ord(inner[-1]) + END)
        if (token := self.whole.get(inner)) is not None:
            return [token]
        length = self.length
        starting: list[list[int]] = [[] for _ in inner]
        for end, token in self.automaton.iter(inner):
            starting[end + 1 - length[token]].append(token)   # the longest comes last
        path, places, at, dead = [], [], 0, set()
        while at < len(inner):
            left = starting[at]
            while left:
                token = left.pop()
                if at + length[token] not in dead and (not path or self.compatible(path[-1], token)):
                    path.append(token)
                    places.append(at)
                    at += length[token]
                    break
            else:
                dead.add(at)
                path.pop()
                at = places.pop()
        return path

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if self.special_pattern and "<|" in text:
            parts = self.special_pattern.split(text)
        else:
            parts = [text]
        out = []
        for i, part in enumerate(parts):
            out.append(self.special[part].to_bytes(4, "little") if i % 2 else
                       b"".join(map(self.words.__getitem__, split_words(part))))
        return b"".join(out)

    # --- decoding ------------------------------------------------------------
    def _decoding_table(self, ids: dict[str, int]) -> None:
        names = [b""] * (max(ids.values()) + 1)
        for name, token in ids.items():
            names[token] = name.encode() + b" "
        self.offsets = np.concatenate(([0], np.cumsum([len(n) for n in names])))
        self.bytes = np.frombuffer(b"".join(names), np.uint8)

    def decode(self, ids: bytes) -> str:
        tokens, out = np.frombuffer(ids, "<u4"), []
        for k in range(0, len(tokens), DECODE_STEP):
            step = tokens[k:k + DECODE_STEP]
            start = self.offsets[step]
            size = self.offsets[step + np.uint32(1)] - start
            stop = np.cumsum(size)
            at = np.arange(stop[-1]) + np.repeat(start - (stop - size), size)
            out.append(self.bytes[at].tobytes())
        return b"".join(out)[:-1].decode()


class _Words(dict):
    """Ids of words already met, as bytes; emptied when it is full."""

    def __init__(self, bpe: Bpe):
        self.bpe = bpe

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.bpe.encode_word(word), "<u4").tobytes()
        if len(word) <= 64:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = ids
        return ids


def split_words(text: str) -> list[str]:
    if text.isascii():
        return ASCII_WORDS.findall(text.lower())
    # one lower-case sigma whatever follows, as a lower-casing by character gives
    text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
    return WORDS.findall(text)


_LOADED: dict[int, Bpe] = {}


def _bpe(sent) -> Bpe:
    """One instance for each worker process and vocabulary."""
    key = hash(sent.value)
    if key not in _LOADED:
        _LOADED[key] = Bpe(sent.value)
    return _LOADED[key]


def encode(docs: DataFrame, vocabulary: str, with_text: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids[, decoded]): ids is binary, four little-endian bytes a token."""
    with open(vocabulary, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = _bpe(sent)
        bpe.words.clear()       # a reused worker keeps the vocabulary, not the last task's words
        for pdf in batches:
            for k in range(0, len(pdf), ROWS_OUT):
                part = pdf.iloc[k:k + ROWS_OUT]
                ids = [bpe.encode(t or "") for t in part["text"]]
                out = {"doc_id": part["doc_id"].to_numpy(), "n_tokens": [len(x) // 4 for x in ids], "ids": ids}
                if with_text:
                    out["decoded"] = [bpe.decode(x) for x in ids]
                yield pd.DataFrame(out)
        bpe.words.clear()
        pa.default_memory_pool().release_unused()

    schema = "doc_id long, n_tokens long, ids binary" + (", decoded string" if with_text else "")
    return docs.select("doc_id", "text").mapInPandas(run, schema)


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, decoded) of rows (doc_id, ids); null ids decode to an empty text."""
    with open(vocabulary, "rb") as f:
        sent = encoded.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = _bpe(sent)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "decoded": [bpe.decode(x or b"") for x in pdf["ids"]]})

    return encoded.select("doc_id", "ids").mapInPandas(run, "doc_id long, decoded string")
