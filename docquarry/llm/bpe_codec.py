"""Byte-level BPE encoding and decoding with reuse of content-defined chunks."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm.common import giving_back, query, table, whole_text

#: a chunk ends where the hash of the last 16 characters has this many zero bits
WINDOW_DOUBLINGS, MASK_BITS = 4, 9
#: characters of chunks that a task remembers
REMEMBERED_CHARS = 12_000_000
#: characters whose chunk ends are found at once
BATCH_CHARS = 1_000_000
#: fixed value: how a byte-level vocabulary writes bytes; the others follow from 256 on
PRINTED_BYTES = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: fixed value: the pre-token pattern of the vocabulary
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ChunkCodec:
    """Encodes and decodes texts through a memory of chunks."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            stored = json.load(file)
        char_of = {b: chr(b) for b in PRINTED_BYTES}
        for b in range(256):
            if b not in char_of:
                char_of[b] = chr(256 + len(char_of) - len(PRINTED_BYTES))
        byte_of = {c: b for b, c in char_of.items()}
        self.special = {t["content"]: t["id"] for t in stored["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in stored["model"]["vocab"].items() if token not in self.special}
        self.core = tiktoken.Encoding("byte level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, tuple[bytes, bytes]] = {}
        self.held = 0

    def forget(self) -> None:
        """Drop the remembered chunks."""
        self.known.clear()
        self.held = 0

    def cuts(self, texts: list[str]) -> list[list[int]]:
        """Places where each text may be cut: both sides of every chunk end.

        A rolling hash chooses the chunk ends.  A join of two chunks is repaired
        by encoding what lies around it anew, outwards until both sides agree
        with the encoding of the whole: at a blank between two characters that are
        none, where no pre-token crosses whatever the rest of the text is.  A
        chunk without such a place is encoded together with its neighbours.
        """
        starts = np.cumsum([0, *map(len, texts)])
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        if len(codes) < 32:
            return [[] for _ in texts]
        rolled, width, factor = codes, 1, 0x01000193
        for _ in range(WINDOW_DOUBLINGS):
            rolled = rolled[:-width] * np.uint32(factor) + rolled[width:]
            width, factor = width * 2, factor * factor & 0xFFFFFFFF
        ends = np.flatnonzero((rolled ^ (rolled >> np.uint32(15))) * np.uint32(0x9E3779B1) < 1 << (32 - MASK_BITS)) + width
        # clearly no white space: visible ASCII and Latin letters
        blanks = np.flatnonzero(codes[1:-1] == 0x20) + 1
        solid = lambda c: (c > 0x20) & (c < 0x7F) | (c >= 0xC0) & (c < 0x250)
        safe = blanks[solid(codes[blanks - 1]) & solid(codes[blanks + 1])]
        after = np.searchsorted(safe, ends)
        places = np.unique(np.concatenate((safe[after[after < len(safe)]], safe[after[after > 0] - 1])))
        own = np.searchsorted(places, starts)
        # the first place of a text might be judged by the text before it
        return [[p for p in (places[a:b] - s).tolist() if p > 0] for a, b, s in zip(own[:-1], own[1:], starts)]

    def chunk(self, text: str) -> tuple[bytes, bytes]:
        """Ids as little-endian 32-bit numbers and the decoded bytes of a chunk."""
        ids = self.core.encode_ordinary(text)
        return np.array(ids, dtype="<u4").tobytes(), self.core.decode_bytes(ids)

    def plain(self, text: str, cuts: list[int], ids: list[bytes], back: list[bytes]) -> None:
        known, start = self.known, 0
        for end in [*cuts, len(text)]:
            part = text[start:end]
            start = end
            found = known.get(part)
            if found is None:
                found = self.chunk(part)
                self.held += len(part)
                if self.held > REMEMBERED_CHARS:
                    self.forget()
                    self.held = len(part)
                known[part] = found
            ids.append(found[0])
            back.append(found[1])

    def split_special(self, text: str) -> list[str]:
        """Plain parts at even places, strings of special tokens between them."""
        if not any(s in text for s in self.special):
            return [text]
        parts, rest = [], text
        while rest is not None:
            at, name = min(((rest.find(s), s) for s in self.special if s in rest), default=(-1, ""))
            if at < 0:
                return [*parts, rest]
            parts += [rest[:at], name]
            rest = rest[at + len(name) :]
        return parts

    def encode(self, texts: list[str]) -> Iterator[tuple[bytes, bytes]]:
        """Ids and decoded bytes of whole texts; special strings take their own id."""
        split = [self.split_special(t) for t in texts]
        cuts = iter(self.cuts([p for parts in split for p in parts]))
        for parts in split:
            ids: list[bytes] = []
            back: list[bytes] = []
            for i, part in enumerate(parts):
                places = next(cuts)
                if i % 2:
                    ids.append(np.array([self.special[part]], dtype="<u4").tobytes())
                    back.append(part.encode())
                else:
                    self.plain(part, places, ids, back)
            yield b"".join(ids), b"".join(back)


@lru_cache(maxsize=2)
def _codec(path: str) -> ChunkCodec:
    return ChunkCodec(path)


def coded_rows(path: str, batches: Iterator[list[str]], with_text: bool = False) -> Iterator[list[list]]:
    """Token counts and hashes of every text of every batch; chunks are remembered until the last one."""
    codec = _codec(path)
    for texts in batches:
        rows, first = [], 0
        while first < len(texts):
            last, chars = first, 0
            while last < len(texts) and (last == first or chars + len(texts[last]) < BATCH_CHARS):
                chars, last = chars + len(texts[last]), last + 1
            for ids, back in codec.encode(texts[first:last]):
                decoded = back.decode("utf-8", "replace")
                row = [len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode("utf-8")).hexdigest()]
                rows.append([*row, np.frombuffer(ids, dtype="<u4").astype(np.int32), decoded] if with_text else row)
            first = last
        del texts  # before the next batch comes
        yield rows
    codec.forget()


def encode(docs: DataFrame, tokenizer_path: str, text_col: str = "text", with_text: bool = True) -> DataFrame:
    """``docs`` with n_tokens, ids_sha256, decoded_sha256, ids and decoded (in place of such columns).

    ``ids`` are those the tokenizer library gives for the file at
    ``tokenizer_path`` (a path that every executor has) without added special
    tokens; strings of special tokens in a text take their own id.  ``decoded`` is
    the text the ids stand for.  ``with_text=False`` leaves both out and keeps the
    hashes.  Null is the empty text, which has no ids; no text is cut; rows that
    repeat are encoded alike.
    """
    fields = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    fields += ", ids array<int>, decoded string" if with_text else ""

    names = ["n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if with_text else [])]

    @F.pandas_udf(fields)
    @giving_back
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for rows in coded_rows(tokenizer_path, map(pd.Series.tolist, parts), with_text):
            yield pd.DataFrame(rows, columns=names)

    kept = [c for c in docs.columns if c not in names]
    coded = docs.select(F.struct(*kept).alias("whole"), run(whole_text(text_col)).alias("coded"))
    return coded.select("whole.*", "coded.*")


@query("op8_bpe_codec")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = encode(docs, public_tokenizers.path("byte_bpe_50k.json"), with_text=False)
    return coded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
