"""What the operators share: reading text columns in bounded pieces, words, and tokenisation."""

from __future__ import annotations

import ctypes
import gc
import os
import re
from collections.abc import Callable, Iterable, Iterator
from contextlib import suppress
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space; ``bytes.split()`` cuts UTF-8 text in just this way.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of text that a Python worker holds as arrays at a time (one longer text is taken whole).
PIECE_BYTES = 4 << 20


def documents(docs: DataFrame) -> DataFrame:
    """``doc_id`` as bigint and ``text`` as string; other columns, whatever their names, are left out."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def pieces(batches: Iterable[pa.RecordBatch], limit: int = PIECE_BYTES, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts sum to about ``limit`` bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        block = np.cumsum(size) // limit
        cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), batch.num_rows]
        for start, stop in zip(cuts, cuts[1:]):
            yield batch.slice(start, stop - start)


def spread(counts: np.ndarray) -> np.ndarray:
    """0, 1, 2, ... within each run of the given lengths."""
    counts = np.asarray(counts, np.int64)
    return np.arange(counts.sum(), dtype=np.int64) - np.repeat(np.cumsum(counts) - counts, counts)


#: Bytes that are usually hashed together, and the base of the polynomial hash.
HASH_BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64, and a random value per byte."""
    up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    values = np.random.default_rng(4).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return np.multiply.accumulate(up), np.multiply.accumulate(down), values


def mix64(x: np.ndarray) -> np.ndarray:
    for _ in range(2):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """:func:`_powers` of at least ``n`` entries, kept for the usual block."""
    claim("hashes", _powers.cache_clear)
    return _powers(max(n, HASH_BLOCK + (1 << 16)))


def default_tokenizer() -> str:
    """Where the public byte-level BPE vocabulary lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


_CLAIMED: dict[str, Callable[[], object]] = {}


def claim(name: str, release: Callable[[], object]) -> None:
    """This Python worker works for ``name`` now: what others have remembered in it is released.

    Workers outlive stages and jobs, and so would the words and ids that earlier ones have looked up.
    """
    if name not in _CLAIMED:
        for other in list(_CLAIMED):
            _CLAIMED.pop(other)()
        give_back()
    _CLAIMED[name] = release


def give_back() -> None:
    """Hand freed memory of this Python worker back to the system, where the system can take it.

    Else the next stage's workers and the JVM stand beside what the largest task of an earlier one has used.
    """
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


# ---------------------------------------------------------------- tokenisation

#: A space before a visible character always starts a new pre-token of a byte-level BPE, so text may be cut there.
_CUT = re.compile(" (?=[!-~¡-¬®-ɏ])")
#: A line feed between visible characters is a pre-token of its own, so what follows it starts anew.
_LINE = re.compile("(?<=[!-~¡-¬®-ɏ])\n(?=[!-~¡-¬®-ɏ])")
_VISIBLE_END = re.compile("[!-~¡-¬®-ɏ]\\Z")
#: Signs that may follow a word; not the apostrophe, which can begin a contraction.
_SIGNS = ".,;:!?#*$%&|"
#: Begins a piece that no space stands before; plainly spaced texts have no such character.
_MARK = "\x01"
#: A full stop or comma behind anything but a letter or digit may belong to a longer pre-token.
_ODD = re.compile("[.,](?<![0-9A-Za-zÀ-ÖØ-öø-ÿ].)")
_CACHE_ENTRIES = 600_000
#: Pieces that the library encodes as one string: its work on a string grows faster than the string.
_JOINED = 32


def _plainly_spaced(text: str) -> bool:
    """Whether every space is a cut: printable characters up to U+00FF and line feeds, and no space before white space or at the end."""
    if "  " in text or " \n" in text or text.endswith(" "):
        return False
    if not text.isascii():
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
    return text.replace("\n", "").isprintable()


def _words(text: str) -> list[str]:
    """The pieces of a plainly spaced text; lines and the commonest signs behind words are pieces of their own, begun by ``_MARK``."""
    if _ODD.search(text):
        return text.split(" ")
    if "\n" in text and not ("\n\n" in text or "\n " in text or text.endswith("\n")):
        text = text.replace("\n", " \x01\n")
    return text.replace(". ", " \x01. ").replace(", ", " \x01, ").split(" ")


class Encoder:
    """Token ids of texts by the ``tokenizers`` library.

    Byte-level vocabularies never join tokens across a cut before " x", so every distinct piece between cuts is
    encoded once and remembered; ids of many new pieces come from one call and are told apart by the tokens' byte
    lengths.  Vocabularies of another kind are applied to whole texts.
    """

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        config = json.loads(spec)
        before = config.get("pre_tokenizer") or {}
        added = [t["content"] for t in config.get("added_tokens") or []]
        self.by_piece = (
            config.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True)
            and not before.get("add_prefix_space") and not any(" " in t for t in added)
        )
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        special = {t["id"]: len(t["content"].encode()) for t in config.get("added_tokens") or []}
        if self.by_piece:
            self.widths = np.array([special.get(i, len(self.tokenizer.id_to_token(i) or "")) for i in range(size)], np.int64)
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}
        self.lines: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> list[str]:
        """Remember the ids of ``new`` pieces; all pieces that this added.

        A piece over several lines is put together from its lines.  Signs behind a letter are a pre-token of their own, so a word is
        encoded once however sentences go on after it.
        """
        later, lines = self.later, self.lines
        marked = [p for p in new if p[0] == _MARK]
        if marked:
            starts = [p[2:] for p in marked if p[1] == "\n"]
            self._encode_all(starts, "\n", found := {})
            later.update((f"{_MARK}\n{p}", found[p]) for p in starts)
            signs = [p for p in marked if p[1] != "\n"]
            later.update(zip(signs, self._whole([p[1:] for p in signs])))
            new = [p for p in new if p[0] != _MARK]
        if not any("\n" in p for p in new):
            return marked + self._learn_lines(new)
        over, single = [], dict.fromkeys(())
        for p in new:
            if "\n" in p and len(cut := _LINE.split(p)) > 1 and _VISIBLE_END.search(cut[-1]):
                over.append((p, cut))
                if cut[0] not in later:
                    single[cut[0]] = None
            else:
                single[p] = None
        added = marked + self._learn_lines(list(single))
        if over:
            unknown = list(set().union(*(cut[1:] for _, cut in over)) - lines.keys())
            self._encode_all(unknown, "\n", lines)
            for p, cut in over:
                later[p] = later[cut[0]] + b"".join([lines[c] for c in cut[1:]])
                added.append(p)
        return added

    def _learn_lines(self, new: list[str]) -> list[str]:
        later, tails, added = self.later, self.tails, list(new)
        parted = [(p, w) for p in new if p[-1] in _SIGNS and (w := p.rstrip(_SIGNS)) and w[-1].isalpha()]
        whole = dict.fromkeys(new)
        for p, _ in parted:
            del whole[p]
        for _, word in parted:
            if word not in later and word not in whole:
                whole[word] = None
                added.append(word)
        self._encode_all(list(whole), " ", later)
        for p, word in parted:
            tail = p[len(word):]
            if tail not in tails:
                tails[tail] = self._whole([tail])[0]
            later[p] = later[word] + tails[tail]
        return added

    def _encode_all(self, new: list[str], before: str, known: dict[str, bytes]) -> None:
        """Ids of ``new`` pieces that follow the character ``before``, its own included, go to ``known``."""
        for at in range(0, len(new), 8192):
            some = [before + p for p in new[at: at + 8192]]
            joined = ["".join(some[k: k + _JOINED]) for k in range(0, len(some), _JOINED)]
            found = self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)
            ids = np.array(list(chain.from_iterable(e.ids for e in found)), self.dtype)
            ends = np.cumsum([len(p) if p.isascii() else len(p.encode()) for p in some])
            reached = np.cumsum(self.widths[ids])
            stops = np.searchsorted(reached, ends) + 1
            if not np.array_equal(reached[stops - 1], ends):
                raise ValueError("the vocabulary does not keep bytes")
            raw, step = ids.tobytes(), self.dtype.itemsize
            stops = (stops * step).tolist()
            known.update(zip(new[at: at + 8192], (raw[a:b] for a, b in zip([0, *stops], stops))))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian integers of :attr:`dtype`; null counts as empty."""
        texts = [t or "" for t in texts]
        if not self.by_piece:
            return self._whole(texts)
        collecting = gc.isenabled()
        gc.disable()  # many strings and no cycles are made here; looking for some takes a tenth of the time
        try:
            return self._by_piece(texts)
        finally:
            if collecting:
                gc.enable()

    def _by_piece(self, texts: list[str]) -> list[bytes]:
        if len(self.first) > _CACHE_ENTRIES // 8:
            self.first.clear()
        cut = [_words(t) if _plainly_spaced(t) else _CUT.split(t) for t in texts]
        heads = [c[0] for c in cut]
        new = list({h for h in heads if h not in self.first})
        self.first.update(zip(new, self._whole(new)))
        for c in cut:
            del c[0]
        added = self._learn(list(set().union(*cut) - self.later.keys()))
        get = self.later.__getitem__
        coded = [self.first[h] + b"".join(map(get, c)) for h, c in zip(heads, cut)]
        if len(self.later) > _CACHE_ENTRIES:  # early pieces are the frequent ones, and stay
            for p in added:
                self.later.pop(p, None)
        for known in (self.tails, self.lines):
            if len(known) > _CACHE_ENTRIES // 8:
                known.clear()
        return coded


@lru_cache(maxsize=1)
def _encoder(spec: str) -> Encoder:
    return Encoder(spec)


def encoder(spec: str) -> Encoder:
    """This worker's encoder of a vocabulary, with the pieces that it remembers."""
    claim("encoder", _encoder.cache_clear)
    return _encoder(spec)


def tokenizer_spec(spark: SparkSession, path: str):
    """The vocabulary file as a broadcast value, so that workers need no file; its size is that of the vocabulary."""
    with open(path, encoding="utf-8") as file:
        return spark.sparkContext.broadcast(file.read())
