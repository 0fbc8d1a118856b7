"""Byte-level BPE with certain cuts: encode fragments independently, concatenate, decode.

A byte pair that stands inside no vocabulary token can never be merged across, so a cut
there is certain. Every (other byte, ASCII white space) pair of a byte-level vocabulary is
of this kind, and the pre-tokenizer always starts a new piece there as well: the text
falls into short fragments "white space + word" whose ids do not depend on their
surroundings. Fragments repeat, so each worker keeps bounded tables of those it has met.
Long fragments (text without white space, of any script) are cut further: where the
pre-tokenizer begins a new piece, and inside a piece at certain pairs of the last byte of a
character and the first of the next. What is still long is encoded and not remembered.

Defined cases: a null text encodes as the empty text (no ids, empty decoded text); special
tokens written in a text become their ids, as the tokenizers library does by default.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.llm.common import extended

#: Fragments a worker remembers at most, in each of a new and an old table.
REMEMBERED = 200_000
#: Fragments above so many characters are also cut inside.
LONG = 200
#: Characters of a fragment that is remembered at most, which bounds the tables in bytes.
KEPT = 64
#: Ranges that hold letters only and have done so for long, so that every
#: version of the character tables takes them for letters.
LETTERS = [(0x41, 0x5A), (0x61, 0x7A), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x24F), (0x391, 0x3A1), (0x3A3, 0x3CE), (0x410, 0x44F), (0x5D0, 0x5EA), (0x621, 0x63A), (0x641, 0x64A), (0x905, 0x939), (0xE01, 0xE30), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3)]
SPACES = b"\t\n\x0b\x0c\r "


def public_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_alphabet() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """One tokenizer in one worker."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        alphabet = byte_alphabet()
        added = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        vocab = {t: i for t, i in self.library.get_vocab(with_added_tokens=True).items() if t not in added}
        self.bytes_of = [b""] * (max([*vocab.values(), *added.values()]) + 1)
        inside = np.zeros((256, 256), bool)
        for token, i in vocab.items():
            raw = bytes(alphabet[c] for c in token)
            self.bytes_of[i] = raw
            if len(raw) > 1:
                a = np.frombuffer(raw, np.uint8)
                inside[a[:-1], a[1:]] = True
        for token, i in added.items():
            self.bytes_of[i] = token.encode()
        self.certain = ~inside
        self.special = {t: np.array([i], "<u4").tobytes() for t, i in added.items()}
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        # a fragment ends before ASCII white space that follows a character which is no
        # white space of any kind and forms a certain pair with it
        spaces = np.frombuffer(SPACES, np.uint8)
        open_after = [b for b in range(256) if b not in SPACES and not self.certain[b, spaces].all()]
        # bytes from 128 on that do not cut cleanly are the last byte of white space such
        # as U+00A0, or of characters that share it: none of these characters ends a fragment
        self.ends = re.compile(r"\s*\S[^\t\n\x0b\x0c\r ]*|\s+") if not any(b < 128 for b in open_after) else None
        self.unclean = frozenset(open_after)
        odd = [chr(c) for c in range(0x80, 0x10000) if not 0xD800 <= c < 0xE000 and (chr(c).isspace() or chr(c).encode()[-1] in self.unclean)]
        self.odd_end = re.compile("[" + "".join(odd) + "\U00010000-\U0010ffff][\t\n\x0b\x0c\r ]")
        self.lengths = np.array([len(b) for b in self.bytes_of], np.int64)
        self.known: dict[str, bytes] = dict(self.special)
        self.old: dict[str, bytes] = {}

    def fragments(self, text: str) -> list[str]:
        if self.ends is None:
            return [text]
        found = self.ends.findall(text)
        if not text.isascii() and self.odd_end.search(text):
            found = self._rejoined(found)
        return found

    def _rejoined(self, found: list[str]) -> list[str]:
        """Joins a fragment to the next where its last character is white space or its
        last byte makes no certain pair with white space."""
        out: list[str] = []
        held = ""
        for f in found:
            held += f
            last = held[-1]
            if last >= "\x80" and (last.isspace() or last.encode()[-1] in self.unclean):
                continue
            out.append(held)
            held = ""
        return [*out, held] if held else out

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        """Ids of new fragments. Those that open with ASCII white space and end cleanly
        stay apart in a row as well, so one call encodes them all."""
        out: dict[str, bytes] = {}
        rows = [f for f in new if f[0] in " \n\t" and not f[-1].isspace() and (f[-1] < "\x80" or f.encode()[-1] not in self.unclean)]
        if rows and self.ends is not None:
            ids = np.array(self.library.encode_batch_fast(["".join(rows)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.cumsum(np.fromiter((len(f) if f.isascii() else len(f.encode()) for f in rows), np.int64, len(rows)))
            at = (np.searchsorted(np.cumsum(self.lengths[ids]), ends) + 1) * 4
            packed = ids.tobytes()
            out.update(zip(rows, (packed[x:y] for x, y in zip([0, *at.tolist()], at.tolist()))))
            new = [f for f in new if f not in out]
        for f, e in zip(new, self.library.encode_batch_fast(new, add_special_tokens=False), strict=True):
            out[f] = np.array(e.ids, "<u4").tobytes()
        return out

    def _values(self, found: list[str]) -> list[bytes]:
        """The ids of each fragment. A full table becomes the old one, from which
        fragments that come again move over."""
        values = list(map(self.known.get, found))
        lost = [i for i, v in enumerate(values) if v is None]
        if lost:
            new = list(dict.fromkeys(found[i] for i in lost))
            if len(self.known) + len(new) > REMEMBERED:
                self.old, self.known = self.known, dict(self.special)
            old = self.old
            self.known.update((f, old[f]) for f in new if f in old)
            fresh = self._learn([f for f in new if f not in self.known])
            self.known.update((f, v) for f, v in fresh.items() if len(f) <= KEPT)
            for i in lost:
                values[i] = fresh[found[i]] if found[i] in fresh else self.known[found[i]]
        return values

    def inner_cuts(self, fragment: str) -> list[str]:
        """Cuts between letters, digits and ASCII punctuation. Between kinds a new piece of
        the pre-tokenizer begins; inside a kind one piece holds both characters, so only
        merges matter, and a certain pair allows none. Apostrophes, which may open a
        contraction, white space and all other characters have no cut beside them."""
        raw = np.frombuffer(fragment.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        kind = np.zeros(len(raw), np.int8)
        for a, b in LETTERS:
            kind[(raw >= a) & (raw <= b)] = 1
        kind[(raw >= 48) & (raw <= 57)] = 2
        kind[(raw > 32) & (raw < 127) & (kind == 0) & (raw != 39)] = 3
        lead = np.select([raw < 0x80, raw < 0x800, raw < 0x10000], [raw, 0xC0 | raw >> 6, 0xE0 | raw >> 12], 0xF0 | raw >> 18)
        last = np.where(raw < 0x80, raw, 0x80 | raw & 63)
        known = (kind[:-1] > 0) & (kind[1:] > 0)
        at = np.flatnonzero(known & ((kind[:-1] != kind[1:]) | self.certain[last[:-1], lead[1:]])) + 1
        bounds = [0, *at.tolist(), len(fragment)]
        return [fragment[a:b] for a, b in zip(bounds, bounds[1:])]

    def cut(self, text: str) -> list[str]:
        """All fragments of a text without special tokens."""
        found = self.fragments(text)
        if max(map(len, found), default=0) > LONG:
            found = [p for f in found for p in (self.inner_cuts(f) if len(f) > LONG else (f,))]
        return found

    def encode(self, text: str | None) -> bytes:
        """Ids of the whole text, packed as little-endian unsigned 32-bit integers."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """As ``encode``; new fragments of several texts are encoded together."""
        flat: list[str] = []
        ends = []
        for t in texts:
            if t and self.at_special is not None and any(s in t for s in self.special):
                for p in self.at_special.split(t):
                    flat += [p] if p in self.special else self.cut(p)
            elif t:
                flat += self.cut(t)
            ends.append(len(flat))
        values = self._values(flat)
        return [b"".join(values[a:b]) for a, b in zip([0, *ends], ends)]

    def decode(self, packed: bytes | None) -> str:
        ids = np.frombuffer(packed or b"", "<u4").tolist()
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", errors="replace")


def grouped(texts: list[str | None], most: int = 500_000) -> Iterator[list[str | None]]:
    """Runs of texts of about ``most`` characters together; a longer text stands alone."""
    held, size = [], 0
    for t in texts:
        if held and size + len(t or "") > most:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t or "")
    if held:
        yield held


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_decode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = "decoded") -> DataFrame:
    """The input with ``ids`` (packed little-endian unsigned 32-bit integers, the usual
    layout of token shards) and, unless None, ``decoded`` (the text those ids decode to).
    Input columns of these names are replaced. No shuffle: one pass over the rows."""
    keep = [c for c in df.columns if c not in (ids, decoded)]
    schema = extended(df, keep, f"`{ids}` binary" + (f", `{decoded}` string" if decoded else ""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                packed = [p for some in grouped(part.column(part.schema.get_field_index(text)).to_pylist()) for p in c.encode_all(some)]
                columns = [part.column(part.schema.get_field_index(k)) for k in keep] + [pa.array(packed, pa.binary())]
                if decoded:
                    columns.append(pa.array([c.decode(p) for p in packed], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, ids, *([decoded] if decoded else [])])

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """The input with ``decoded``, the text of packed ``ids`` (null: empty)."""
    keep = [c for c in df.columns if c != decoded]
    schema = extended(df, keep, f"`{decoded}` string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            texts = [c.decode(p) for p in b.column(b.schema.get_field_index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(k)) for k in keep], pa.array(texts, pa.string())], names=[*keep, decoded])

    return df.mapInArrow(run, schema)


def digests(encoded: DataFrame, *keep: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """(*keep, n_tokens, ids_sha256, decoded_sha256) of encoded rows."""
    n = (F.octet_length(ids) / 4).cast("long")
    return encoded.select(*keep, n.alias("n_tokens"), F.sha2(F.col(ids), 256).alias("ids_sha256"), F.sha2(F.col(decoded).cast("binary"), 256).alias("decoded_sha256"))
