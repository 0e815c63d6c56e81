"""SentencePiece BPE encoding that keeps source offsets, and decoding.

A text is normalised by longest-prefix matches in the model's compiled character map, each
normalised character remembering the source byte it came from; white space becomes the meta
symbol; the result is cut into units between which no piece of the vocabulary can lie, each
unit is merged by piece rank, and the pieces are projected back on bytes of the source. A model
without a character map takes the identity. Pieces of a text are contiguous in its source, so
the end of each piece tells its span: it begins where the one before ends.

Results in odd cases: a null or empty text has no pieces and decodes to the empty string; rows
are independent, so repeated ids and ties change nothing; extra columns pass through; an empty
table gives an empty table. Very long texts are encoded whole: long units merge with a heap.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import only

META = "▁"
#: Bytes of a worker's memory of units, half of it for those met since the other half was full;
#: characters of a unit that it takes; what an entry takes besides its characters and pieces.
MEMORY, UNIT, ENTRY = 64 << 20, 48, 200
#: Rows and characters of an output batch.
ROWS, CHARS = 256, 1_000_000
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6
_BPE, _NONE = 2, 1 << 40


class CharMap:
    """The compiled character map: a double-array trie of source byte strings, whose values are
    places in a block of NUL-terminated replacements."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little")
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.texts = blob[4 + size :]

    def longest(self, source: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest entry that starts at ``at``, and what replaces it."""
        units, found = self.units, None
        offset = lambda u: (u >> 10) << ((u & 512) >> 6)
        node = offset(units[0])
        for k in range(at, len(source)):
            node ^= source[k]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != source[k]:
                break
            node ^= offset(unit)
            if unit >> 8 & 1:
                found = k + 1 - at, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        return found[0], self.texts[found[1] : self.texts.index(b"\0", found[1])]


class Pieces:
    """A model file's normaliser, vocabulary and merge order."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        spec, trainer = proto.normalizer_spec, proto.trainer_spec
        if proto.pieces and trainer.model_type != _BPE or trainer.treat_whitespace_as_suffix or any(p.type == _USER for p in proto.pieces):
            raise ValueError("only BPE models with white space as prefix and without user-defined symbols are supported")
        self.map = CharMap(spec.precompiled_charsmap) if spec.precompiled_charsmap else None
        self.prefix, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.space = META if self.escape else " "
        self.fallback, self.unknown_surface = trainer.byte_fallback, trainer.unk_surface.encode()
        normal = {p.piece: i for i, p in enumerate(proto.pieces) if p.type in (_NORMAL, _UNUSED)}
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces)}
        order = {s: k for k, s in enumerate(sorted({p.score for p in proto.pieces}, reverse=True))}
        self.rank = {p: order[proto.pieces[i].score] for p, i in normal.items()}
        self.types = [p.type for p in proto.pieces]
        self.unknown = next((i for i, p in enumerate(proto.pieces) if p.type == _UNKNOWN), 0)
        self.byte_ids = [self.ids.get(f"<0x{b:02X}>", self.unknown) for b in range(256)]
        if any(p.type == _UNUSED for p in proto.pieces):
            raise ValueError("models with unused pieces are not supported")
        # where no piece can lie: before a meta symbol after another character, if no piece holds
        # one there; around a line feed, if no longer piece holds one
        long = [p for p in normal if len(p) > 1]
        line = "" if any("\n" in p for p in long) else "\n"
        inner = any(re.search(f"[^{META}]{META}", p) for p in long)
        unit = f"[^{line}]+" if inner and line else ".+" if inner else f"{META}+[^{META}{line}]*|[^{META}{line}]+"
        self.cut = re.compile(f"{unit}|{line}" if line else unit, re.DOTALL).findall
        self.surface = [b"" if p.type == _CONTROL else self.unknown_surface if p.type == _UNKNOWN else bytes([int(p.piece[3:5], 16)]) if p.type == _BYTE else p.piece.replace(META, " ").encode() for p in proto.pieces]
        self.memory: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0

    def normalise(self, text: str) -> tuple[str, list[int] | None]:
        """The normalised text, and for each of its characters and its end the source byte it
        comes from; None for the places where every character stands for itself (with a first
        meta symbol of no source bytes where the model adds one)."""
        if not text:
            return "", []
        if self.map is None and not self.squeeze:
            return (self.space if self.prefix else "") + (text.replace(" ", META) if self.escape else text), None
        source, out, places, at = text.encode(), [], [], 0
        while at < len(source):
            found = self.map.longest(source, at) if self.map else None
            if found is None:
                step = 1 if source[at] < 0x80 else 2 if source[at] < 0xE0 else 3 if source[at] < 0xF0 else 4
                found = step, source[at : at + step]
            chars = found[1].decode()
            out += chars
            places += [at] * len(chars)
            at += found[0]
        places.append(at)
        if self.squeeze:
            keep = [k for k, c in enumerate(out) if c != " " or (k and out[k - 1] != " ")]
            while keep and out[keep[-1]] in (" ", self.space):
                keep.pop()
            if not keep:
                return "", []
            last = places[keep[-1] + 1]
            out, places = [out[k] for k in keep], [*(places[k] for k in keep), last]
        if self.prefix and out:
            out.insert(0, " ")
            places.insert(0, places[0])
        return "".join(out).replace(" ", self.space), places

    def _merge(self, unit: str) -> list[str]:
        rank, parts = self.rank.get, list(unit)
        if len(parts) > 48:
            return self._merge_long(parts)
        ranks = [rank(a + b, _NONE) for a, b in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best == _NONE:
                break
            at = ranks.index(best)
            whole = parts[at] = parts[at] + parts[at + 1]
            del parts[at + 1], ranks[at]
            if at < len(ranks):
                ranks[at] = rank(whole + parts[at + 1], _NONE)
            if at:
                ranks[at - 1] = rank(parts[at - 1] + whole, _NONE)
        return parts

    def _merge_long(self, parts: list[str]) -> list[str]:
        rank, n = self.rank.get, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k, parts[k] + parts[k + 1]) for k in range(n - 1) if (r := rank(parts[k] + parts[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, k, whole = heapq.heappop(heap)
            j = after[k] if parts[k] else n
            if j >= n or parts[k] + parts[j] != whole:
                continue
            parts[k], parts[j] = whole, ""
            after[k] = after[j]
            if after[k] < n:
                before[after[k]] = k
            for a, b in ((before[k], k), (k, after[k])):
                if a >= 0 and b < n and (r := rank(parts[a] + parts[b])) is not None:
                    heapq.heappush(heap, (r, a, parts[a] + parts[b]))
        return [p for p in parts if p]

    def _unit(self, unit: str) -> tuple[list[int], list[int]]:
        """Ids of a unit, and the characters that each piece takes (bytes of a character that is
        not in the vocabulary take none but the last)."""
        ids, chars = [], []
        known, unknown = self.ids.get, self.unknown
        for part in self._merge(unit):
            i = known(part, unknown)
            if i == unknown and self.fallback:
                raw = part.encode()
                ids += [self.byte_ids[b] for b in raw]
                chars += [0] * (len(raw) - 1) + [len(part)]
            else:
                ids.append(i)
                chars.append(len(part))
        return ids, chars

    def _known(self, unit: str) -> bytes:
        """Id and source bytes of each piece, as packed int32, where characters stand for themselves."""
        if found := self.older.get(unit):
            return self._remember(unit, found)
        ids, lengths = self._unit(unit)
        if not unit.lstrip(META).isascii():
            at = 0
            for k, n in enumerate(lengths):
                part = unit[at : at + n]
                lengths[k] = len(part.encode()) - 2 * part.count(META)
                at += n
        pairs = array("i", ids + lengths)
        pairs[0::2], pairs[1::2] = array("i", ids), array("i", lengths)
        found = pairs.tobytes()
        return self._remember(unit, found) if len(unit) <= UNIT else found  # longer ones rarely come again

    def _remember(self, unit: str, found: bytes) -> bytes:
        if self.held >= MEMORY // 2:
            self.older, self.memory, self.held = self.memory, {}, 0
        self.memory[unit] = found
        self.held += ENTRY + 4 * len(unit) + len(found)
        return found

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and for each the source byte at which its span ends."""
        normal, places = self.normalise(text or "")
        if not normal:
            return np.empty(0, np.int32), np.empty(0, np.int32)
        if places is None and META not in text:
            memory, known = self.memory, self._known
            pairs = np.frombuffer(b"".join([memory.get(u) or known(u) for u in self.cut(normal)]), np.int32).reshape(-1, 2)
            ends = pairs[:, 1].cumsum(dtype=np.int32)
            return pairs[:, 0].copy(), ends - 1 if self.prefix else ends
        if places is None:  # a meta symbol in the source has three bytes, one from a space has one
            places, at = [0] if self.prefix else [], 0
            for c in text:
                places.append(at)
                at += len(c.encode())
            places.append(at)
        ids, ends, at = [], [], 0
        for unit in self.cut(normal):
            own, chars = self._unit(unit)
            ids += own
            for n in chars:
                at += n
                ends.append(places[at])
            for k in range(len(chars) - 1, -1, -1):  # bytes without a surface end where they begin
                if chars[k] == 0:
                    ends[len(ends) - len(chars) + k] = places[at - sum(chars[k:])]
        return np.array(ids, np.int32), np.array(ends, np.int32)

    def decode(self, ids) -> str:
        """The text of ids: pieces joined, meta symbols as spaces without the one that was put
        first, runs of byte pieces as UTF-8 with U+FFFD for each byte that is not."""
        surface = self.surface
        ids = ids.tolist() if hasattr(ids, "tolist") else list(ids)
        raw = b"".join([surface[i] for i in ids])
        lead = next((i for i in ids if surface[i]), None)
        if lead is not None and (self.prefix or self.squeeze) and self.types[lead] == _NORMAL and raw[:1] == b" ":
            raw = raw.lstrip(b" ") if self.squeeze else raw[1:]
        try:
            return raw.decode()
        except UnicodeDecodeError:
            out = []
            while raw:
                try:
                    out.append(raw.decode())
                    break
                except UnicodeDecodeError as e:
                    out.append(raw[: e.start].decode() + "�")
                    raw = raw[e.start + 1 :]
            return "".join(out)


def encode_documents(docs: DataFrame, model: bytes, text_col: str = "text") -> DataFrame:
    """``docs`` plus ``pieces__ids`` and ``pieces__ends`` (array<int>; a piece spans the source
    bytes from the end before it to its own) and ``pieces__decoded``, the text of the ids."""
    own = [F.col(f"`{c}`") for c in docs.columns]
    frame = docs.select(*own, F.col(f"`{text_col}`").cast("string").alias("pieces__text"))
    schema = T.StructType([*docs.schema.fields, T.StructField("pieces__ids", T.ArrayType(T.IntegerType())), T.StructField("pieces__ends", T.ArrayType(T.IntegerType())), T.StructField("pieces__decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = only(("pieces", model), lambda: Pieces(model))
        for batch in batches:
            texts, start = batch.column(batch.num_columns - 1), 0
            while start < batch.num_rows:
                ids, ends, decoded, chars = [], [], [], 0
                while start + len(ids) < batch.num_rows and len(ids) < ROWS and chars < CHARS:
                    text = texts[start + len(ids)].as_py() or ""
                    found = pieces.encode(text)
                    ids.append(found[0])
                    ends.append(found[1])
                    decoded.append(pieces.decode(found[0]))
                    chars += len(text)
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(x))) for x in (ids, ends)]
                kept = [c.slice(start, len(ids)) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*kept, *lists, pa.array(decoded, pa.string())], names=[*batch.schema.names[:-1], "pieces__ids", "pieces__ends", "pieces__decoded"])
                start += len(ids)

    return frame.mapInArrow(run, schema)


def model_bytes(path: str | None = None) -> bytes:
    """A model file's bytes; by default the public 32k piece model that is installed."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of ids and decoded texts, and the source bytes that the spans cover."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = encode_documents(docs, model_bytes())
    ids = F.col("pieces__ids")
    return done.select("doc_id", F.size(ids).cast("long").alias("n_tokens"), F.sha2(F.array_join(ids.cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("pieces__decoded", 256).alias("decoded_sha256"), F.coalesce(F.get("pieces__ends", F.size(ids) - 1), F.lit(0)).cast("long").alias("n_bytes_covered"))
