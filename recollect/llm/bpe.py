"""BPE encoding and decoding with a published vocabulary, by a pair occurrence index.

The distinct words of a run of texts are laid out in one array of symbols. An index maps each mergeable pair to all its positions
in that array. The pair of the lowest active rank is taken and merged at all its positions in one step, and the lists of the
neighbouring pairs that come about are updated, until no pair is left. Words are independent of each other, so the order of ranks
over the whole array is, for each word, the order that the word alone would take. Where the order inside a word matters (a pair of
equal symbols, or one whose result can take part in a pair of a lower rank), only the first position of each word is merged, and
the others wait under the same rank.

A text is split between white space into chunks, and each distinct chunk of a run into words. Chunks of printable ASCII and Latin
letters are split here; what else there is goes through the library's normaliser and pre-tokeniser, chunk by chunk. Texts then
take their chunks' ids by gathering. Nothing is remembered from one run to the next, so memory follows the run.

Defined cases: a null text is an empty text: no ids, 0 tokens, an empty decoded text; strings of special tokens that stand in a
text become those tokens, as the library does; an empty table gives an empty table; rows are independent of each other; a file of
another kind (other normaliser, other word pattern) is refused with a ValueError.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, text_of
from .words import bytes_of, pick_lists, runs, split_words

# The form of the file that this encoder reads, as the file writes it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = ("NFC", "Replace", "Lowercase")
PRETOKENIZERS = ("Split", "ByteLevel")

#: Chunks with any other character are not plain: printable ASCII and Latin letters, which no normaliser but lower-casing changes.
_NOT_PLAIN = "[^\\x20-~À-ÖØ-öø-ÿ]"
#: Classes of the bytes of plain lower-case chunks: 0 the line feed between chunks, 1 letters, 2 digits, 3 others.
_CLASS = np.full(256, 3, np.uint8)
_CLASS[10], _CLASS[97:123], _CLASS[128:], _CLASS[48:58] = 0, 1, 1, 2


def plain_words(chunks: bytes) -> np.ndarray:
    """Where the words of plain lower-case chunks begin, which line feeds separate; a line feed is a word of its own."""
    b = np.frombuffer(chunks, np.uint8)
    kind = _CLASS[b]
    begins = np.ones(len(b), bool)
    begins[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2) | (kind[1:] == 0)
    at = np.flatnonzero((b == ord("'")) & begins)
    one, two = (np.concatenate([b[k:], np.full(k, 10, np.uint8)])[at] for k in (1, 2))
    is_one = np.isin(one, np.frombuffer(b"stmd", np.uint8))
    is_two = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    for own, k in ((at[is_one], 1), (at[is_two], 2)):  # an apostrophe takes these letters; what follows is a word of its own
        begins[own + 1] = False
        follows = own + 1 + k
        begins[follows[follows < len(b)]] = True
    return np.flatnonzero(begins)


class _Partners:
    """For each symbol the symbols that it makes a pair with, in order, and the pairs' ranks."""

    def __init__(self, of: np.ndarray, other: np.ndarray, size: int):
        order = np.lexsort((other, of))
        self.other, self.rank = other[order].astype(np.int32), order.astype(np.int32)
        self.at = np.searchsorted(of[order], np.arange(size + 1)).tolist()

    def __contains__(self, symbol: int) -> bool:
        return self.at[symbol] < self.at[symbol + 1]

    def ranks(self, symbol: int, others: np.ndarray) -> np.ndarray:
        """The rank of the pair of symbol and each of others, or -1."""
        s, e = self.at[symbol], self.at[symbol + 1]
        own = self.other[s:e]
        at = np.minimum(np.searchsorted(own, others), e - s - 1)
        return np.where(own[at] == others, self.rank[s:e][at], -1)


class Encoder:
    """Encodes texts with a word-level BPE file of the tokenizers library (lower-casing, marked word ends)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self._check(spec)
        end = spec["model"]["end_of_word_suffix"]
        vocab: dict[str, int] = spec["model"]["vocab"]
        n = len(spec["model"]["merges"])
        self.left, self.right, self.made = ([0] * n for _ in range(3))
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.left[rank], self.right[rank], self.made[rank] = vocab[a], vocab[b], vocab[a + b]
        left, right = np.array(self.left, np.int64), np.array(self.right, np.int64)
        size = 1 + max(vocab.values())
        # Pairs by their left symbol and by their right one: the other symbol (sorted), and the rank.
        self.by_left, self.by_right = _Partners(left, right, size), _Partners(right, left, size)
        # A result that is part of a pair of a lower rank: there the order inside a word matters.
        lowest = np.full(size, n, np.int64)
        np.minimum.at(lowest, left, np.arange(n))
        np.minimum.at(lowest, right, np.arange(n))
        self.in_turn = ((lowest[self.made] < np.arange(n)) | (left == right)).tolist()
        # The byte alphabet of the format: printable Latin-1 bytes stand for themselves, the others for 256 and on, in order.
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        of = dict(zip([*own, *(i for i in range(256) if i not in own)], [*own, *range(256, 324)], strict=True))
        self.byte = {chr(c): b for b, c in of.items()}
        self.inner = np.array([vocab.get(chr(of[b]), -1) for b in range(256)], np.int32)
        self.final = np.array([vocab.get(chr(of[b]) + end, -1) for b in range(256)], np.int32)
        # Ranks of pairs of single bytes, which all words begin as.
        single = 1 + int(max(self.inner.max(), self.final.max()))
        self.first = np.full((single, single), -1, np.int32)
        low = (left < single) & (right < single)
        self.first[left[low], right[low]] = np.flatnonzero(low)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")" if self.special else "((?!))")
        self.token = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        ids = range(1 + max(self.token))
        self.written = pa.array([str(i) for i in ids])
        self.tokens = pa.array([self.token.get(i, "") for i in ids])

    @staticmethod
    def _check(spec: dict) -> None:
        norm, pre, model = spec["normalizer"] or {}, spec["pre_tokenizer"] or {}, spec["model"]
        norms, pres = norm.get("normalizers", []), pre.get("pretokenizers", [])
        fits = (
            model["type"] == "BPE" and model.get("end_of_word_suffix") and not model.get("byte_fallback") and not model.get("ignore_merges") and not model.get("dropout")
            and tuple(x["type"] for x in norms) == NORMALIZERS and norms[1]["pattern"] == {"Regex": r"\s+"} and norms[1]["content"] == " "
            and tuple(x["type"] for x in pres) == PRETOKENIZERS and pres[0]["pattern"] == {"Regex": PATTERN} and pres[0]["invert"]
            and not pres[1]["add_prefix_space"] and not pres[1].get("use_regex", True) and not any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
        )
        if not fits:
            raise ValueError("not a word-level BPE file of the form that this encoder reads")

    # Merging ---------------------------------------------------------------------------------------------------------

    def merge(self, ends: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words (not empty) given by their bytes, by the pair occurrence index over all of them: ids and offsets."""
        starts, n = ends[:-1], len(ends) - 1
        if not n:
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        symbol = self.inner[data]
        symbol[ends[1:] - 1] = self.final[data[ends[1:] - 1]]
        after = np.arange(1, len(symbol) + 1, dtype=np.int32)
        after[ends[1:] - 1] = -1
        before = np.arange(-1, len(symbol) - 1, dtype=np.int32)
        before[starts] = -1
        word = np.repeat(np.arange(n, dtype=np.int32), np.diff(ends))
        places: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enter(at: np.ndarray, rank: np.ndarray) -> None:
            real = rank >= 0
            at, rank = at[real], rank[real]
            if not len(at):
                return
            if len(at) > 1:
                order = np.argsort(rank, kind="stable")
                at, rank = at[order], rank[order]
                cut = [0, *(np.flatnonzero(rank[1:] != rank[:-1]) + 1).tolist(), len(at)]
            else:
                cut = [0, 1]
            for s, e in zip(cut[:-1], cut[1:], strict=True):
                r = int(rank[s])
                if r in places:
                    places[r].append(at[s:e])
                else:
                    places[r] = [at[s:e]]
                    heapq.heappush(active, r)

        inside = np.flatnonzero(after >= 0).astype(np.int32)
        enter(inside, self.first[symbol[inside], symbol[inside + 1]])
        while active:
            rank = heapq.heappop(active)
            lists = places.pop(rank)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            a, b, new = self.left[rank], self.right[rank], self.made[rank]
            j = after[at]
            valid = (symbol[at] == a) & (j >= 0) & (symbol[j] == b)
            if not valid.all():
                at = at[valid]
                if not len(at):
                    continue
                j = after[at]
            if self.in_turn[rank] and len(at) > 1:
                later = np.zeros(len(at), bool)
                later[1:] = word[at[1:]] == word[at[:-1]]
                if later.any():
                    places[rank] = [at[later]]
                    heapq.heappush(active, rank)
                    at, j = at[~later], j[~later]
            symbol[at], symbol[j] = new, -1
            follows = after[j]
            after[at] = follows
            some = follows >= 0
            follows, left = follows[some], at[some]
            before[follows] = left
            if new in self.by_left:
                enter(left, self.by_left.ranks(new, symbol[follows]))
            if new in self.by_right:
                left = before[at]
                left = left[left >= 0]
                enter(left, self.by_right.ranks(new, symbol[left]))
        alive = symbol >= 0
        return symbol[alive], np.concatenate([[0], np.cumsum(alive)])[ends]

    # Chunks and texts -------------------------------------------------------------------------------------------------

    def split_chunk(self, chunk: str) -> list[bytes | int]:
        """Words (in bytes) of a chunk that is not plain; special tokens are ids."""
        out: list[bytes | int] = []
        for k, part in enumerate(self._special.split(chunk)):
            if k % 2:
                out.append(self.special[part])
            elif part:
                out += [bytes(map(self.byte.__getitem__, w)) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))]
        return out

    def chunk_ids(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each chunk: ids and offsets."""
        odd = pc.or_(pc.match_substring_regex(chunks, _NOT_PLAIN), pc.match_substring(chunks, "<|")).to_numpy(zero_copy_only=False)
        order = np.argsort(odd, kind="stable")  # plain chunks first
        plain, rest = chunks.filter(pa.array(~odd)), chunks.filter(pa.array(odd))
        words = pa.array([], pa.binary())
        if len(plain):
            blob = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(plain)], pa.int32()), plain), "\n")[0].as_py().lower().encode()
            at = np.append(plain_words(blob), len(blob)).astype(np.int32)
            words = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(blob)])
        specials: dict[bytes, int] = {}  # stand-ins that no word can be: words hold no line feed
        if len(rest):
            more: list[bytes] = [b"\n"] * (len(plain) > 0)
            for k, chunk in enumerate(rest.to_pylist()):
                more += [b"\n"] * (k > 0)
                for w in self.split_chunk(chunk):
                    if isinstance(w, int):
                        specials[b"\n%d" % w], w = w, b"\n%d" % w
                    more.append(w)
            words = pa.concat_arrays([words, pa.array(more, pa.binary())])
        coded = words.dictionary_encode()
        codes, distinct = coded.indices.to_numpy(), coded.dictionary
        cut = pc.index(distinct, b"\n").as_py()
        marks = {pc.index(distinct, m).as_py(): i for m, i in specials.items()}
        ends, data = bytes_of(distinct)
        ids, at = self.merge(ends, data) if not marks and cut < 0 else self._merge_but(ends, data, {cut: None, **marks})
        # Chunks are between the cuts, plain ones first.
        is_cut = codes == cut
        bounds = np.concatenate([[0], np.cumsum(~is_cut)[is_cut], [int((~is_cut).sum())]]) if len(chunks) else np.zeros(1, np.int64)
        all_ids, word_at = pick_lists(ids, at, codes[~is_cut])
        chunk_at = word_at[bounds]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return pick_lists(all_ids, chunk_at, place)

    def _merge_but(self, ends: np.ndarray, data: np.ndarray, but: dict[int, int | None]) -> tuple[np.ndarray, np.ndarray]:
        """As merge, where the words numbered in `but` stand for one id or for none."""
        n = len(ends) - 1
        real = np.ones(n, bool)
        real[[k for k in but if k >= 0]] = False
        own, own_at = pick_lists(data, ends, np.flatnonzero(real))
        ids, at = self.merge(own_at, own)
        size = np.zeros(n, np.int64)
        size[real] = np.diff(at)
        for k, i in but.items():
            if i is not None:
                size[k] = 1
        out_at = np.concatenate([[0], np.cumsum(size)])
        out = np.empty(out_at[-1], ids.dtype)
        fill = np.ones(len(out), bool)
        for k, i in but.items():
            if i is not None:
                out[out_at[k]], fill[out_at[k]] = i, False
        out[fill] = ids
        return out, out_at

    def encode_run(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text begins (and the last ends)."""
        offsets, codes, chunks = split_words(texts)
        ids, at = self.chunk_ids(chunks)
        out, ends = pick_lists(ids, at, codes)
        return out, ends[offsets]

    def encode(self, text: str) -> list[int]:
        return self.encode_run(pa.array([text], pa.string()))[0].tolist()

    def decode(self, ids: Iterable[int]) -> str:
        """As the library does for a file without a decoder: tokens joined by a space; ids not in the vocabulary are left out."""
        return " ".join(self.token[i] for i in ids if i in self.token)

    def joined(self, ids: np.ndarray, at: np.ndarray, names: pa.Array) -> pa.Array:
        """For each list of ids their names joined by one space."""
        lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), names.take(pa.array(ids)))
        return pc.binary_join(lists, " ")


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker."""
    return Encoder(path)


def _texts(column: pa.Array) -> pa.Array:
    return pc.fill_null(column, "")


def encode_documents(docs: DataFrame, path: str, text: str = "text", into: str = "ids") -> DataFrame:
    """docs with an array column of ids."""
    ship(docs.sparkSession)

    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        e = encoder(path)
        for b in batches:
            parts = []
            for lo, hi in runs(b):
                found, at = e.encode_run(b.slice(lo, hi - lo))
                parts.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(found, pa.int32())))
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

    return docs.withColumn(into, _arrow(ids, "array<int>")(text_of(text)))


def decode_documents(docs: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """docs with the text that the ids stand for; null ids count as none."""
    ship(docs.sparkSession)

    def texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        e = encoder(path)
        for b in batches:
            yield pa.array([e.decode(x or ()) for x in b.to_pylist()], pa.string())

    return docs.withColumn(into, _arrow(texts, "string")(F.col(ids)))


def _arrow(function, kind: str):
    """An iterator Arrow UDF; the types are named here because annotations are strings in this module."""
    function.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(function, kind)


def op2_bpe(docs: DataFrame, path: str) -> DataFrame:
    """The contract's digest: ids and tokens of a run are written out and joined in Arrow; texts hash their parts."""
    ship(docs.sparkSession)

    def digest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        e = encoder(path)
        for b in batches:
            n, written, decoded = [], [], []
            for lo, hi in runs(b):
                ids, at = e.encode_run(b.slice(lo, hi - lo))
                n += np.diff(at).tolist()
                for names, out in ((e.written, written), (e.tokens, decoded)):
                    ends, data = bytes_of(e.joined(ids, at, names))
                    ends = ends.tolist()
                    out += [hashlib.sha256(data[s:t]).hexdigest() for s, t in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(written, pa.string()), pa.array(decoded, pa.string())], names=["n_tokens", "ids_sha256", "decoded_sha256"])

    made = _arrow(digest, "n_tokens long, ids_sha256 string, decoded_sha256 string")
    return docs.select("doc_id", made(text_of()).alias("d")).select("doc_id", "d.*")
