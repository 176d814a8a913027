"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text is normalised as the model asks (a leading space mark, spaces become marks), cut at places that no
vocabulary piece crosses, and each part is merged with a score-ordered agenda of adjacent symbol pairs.
The ids are the agenda's. Every part that a worker has not met before is encoded by the sentencepiece library
too: ``n_differ`` counts the parts of a text, new to its worker, whose ids are not the library's. The library decodes the agenda's ids.

Null text counts as empty; an empty text has no ids. Very long parts are merged in full but not cached. Equal
texts, repeated rows among them, get equal ids; an empty table gives an empty one. Other columns stay, but for one
that has the result's name, which the result replaces.
"""

from __future__ import annotations

import re
from array import array
from heapq import heapify, heappop, heappush
from operator import add
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import held

MARK = "▁"
#: Parts held in a worker's cache, and the longest part that is held.
CACHE_PARTS, CACHE_CHARS = 700_000, 48

SCHEMA = "struct<ids: array<int>, decoded: string, n_differ: int>"


class PieceCoder:
    """Encoder and decoder of one model, with a bounded cache of parts."""

    def __init__(self, proto: bytes):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        every = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        usable = [i for i in range(len(every)) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        self.ids = {every[i]: i for i in usable}
        self.cost = {every[i]: -sp.get_score(i) for i in usable}
        self.bytes = {int(every[i][3:5], 16): i for i in range(len(every)) if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        longer = [p for p in self.ids if len(p) > 1]
        joined = {c for p in longer for c in p}
        alone = "".join(re.escape(chr(c)) for c in range(128) if chr(c) not in joined)
        # Stops: ASCII signs that no piece holds right after a letter or digit; a part ends before one, unless a sign precedes it.
        ahead: dict[str, set[str]] = {}
        for p in longer:
            for x, y in zip(p, p[1:], strict=False):
                ahead.setdefault(y, set()).add(x)
        stops = [c for c in map(chr, range(33, 127)) if c in joined and not c.isalnum() and not any(x.isalpha() or x.isdecimal() for x in ahead.get(c, ()))]
        signs = "".join(sorted({re.escape(x) for c in stops for x in ahead.get(c, ()) if x != MARK}))
        stop = "".join(map(re.escape, stops))
        plain = f"[^{MARK}{alone}{stop}]+"
        inside = f"(?:{plain}|(?<=[{MARK}{signs}])[{stop}])*" if stops else f"(?:{plain})?"
        #: None if some piece crosses the place before a mark: then a text is one part.
        self.parts = None if any(re.search(f"[^{MARK}]{MARK}", p) for p in longer) else re.compile(f"(?:{MARK}+|[^{MARK}{alone}]){inside}" + (f"|[{alone}]" if alone else ""))
        self.cache: dict[str, bytes] = {}
        #: Cached parts that decode to another text than their own.
        self.odd: dict[str, str] = {}

    def merge(self, part: str) -> list[int]:
        """Ids of a part: the pair of highest score merges first, of equal ones the leftmost."""
        cost, symbols = self.cost, list(part)
        n = len(symbols)
        agenda = [(cost[pair], i, pair) for i, pair in enumerate(map(add, symbols, symbols[1:])) if pair in cost]
        if len(agenda) > 1:
            heapify(agenda)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while agenda:
            _, i, pair = heappop(agenda)
            left, j = symbols[i], after[i]
            if left is None or j >= n or left + symbols[j] != pair:
                continue  # one of the two has merged meanwhile
            symbols[i], symbols[j] = pair, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (wider := pair + symbols[k]) in cost:
                    heappush(agenda, (cost[wider], i, wider))
            if (h := before[i]) >= 0 and (wider := symbols[h] + pair) in cost:
                heappush(agenda, (cost[wider], h, wider))
        out: list[int] = []
        for symbol in symbols:
            if symbol is None:
                continue
            if (known := self.ids.get(symbol)) is not None:
                out.append(known)
            elif self.bytes:
                out += [self.bytes[b] for b in symbol.encode()]
            else:
                out.append(self.unknown)
        return out

    def learn(self, parts: list[str]) -> tuple[dict[str, bytes], dict[str, str], int]:
        """Ids of new parts, decoded texts that are not their own, and how many the library encodes in another way."""
        # The library puts a mark before every text: it stands for a part's own first mark, or a line feed keeps it apart.
        asked = [p[1:].replace(MARK, " ") if p[0] == MARK else "\n" + p for p in parts]
        told = self.library.encode(asked, num_threads=1)
        line, merge = self.library.encode("\n"), self.merge
        ours = [merge(p) if p[0] == MARK else line + merge(p) for p in parts]
        texts = self.library.decode(ours, num_threads=1)
        found, odd, differ = {}, {}, 0
        for part, own, theirs, asked_text, text in zip(parts, ours, told, asked, texts, strict=True):
            if part != MARK:  # a lone mark: the library encodes an empty text as nothing
                differ += own != theirs
                if text != asked_text:
                    odd[part] = " " + text if part[0] == MARK else text[1:]
            found[part] = array("i", own if part[0] == MARK else own[len(line) :]).tobytes()
        return found, odd, differ

    def encode(self, text: str) -> tuple[bytes, str, int]:
        """(ids as int32 bytes, decoded text, parts that differ) of a whole text."""
        if not text:
            return b"", "", 0
        text = MARK + text.replace(" ", MARK)
        if self.parts is None:
            ids = self.merge(text)
            return array("i", ids).tobytes(), self.library.decode(ids), int(self.library.encode(text[1:].replace(MARK, " ")) != ids)
        cache, differ = self.cache, 0
        parts = self.parts.findall(text)
        if new := {p for p in parts if p not in cache}:
            if len(cache) + len(new) > CACHE_PARTS:
                cache.clear()
                self.odd.clear()
                new = set(parts)
            found, odd, differ = self.learn(list(new))
            cache.update(found)
            self.odd.update(odd)
        ids = b"".join([cache[p] for p in parts])
        if self.odd and not self.odd.keys().isdisjoint(parts):
            decoded = "".join([self.odd.get(p) or p.replace(MARK, " ") for p in parts])
        else:
            decoded = text.replace(MARK, " ")
        for p in new:
            if len(p) > CACHE_CHARS:
                del cache[p]
                self.odd.pop(p, None)
        return ids, decoded[1:], differ


def coder(proto: bytes) -> PieceCoder:
    """The worker's own coder of a model."""
    return held(f"pieces {crc32(proto)}", lambda: PieceCoder(proto))


def encoded(text: Column, proto: bytes) -> Column:
    """Column of (ids, decoded, n_differ) for a text column; proto is the model file's content."""

    @F.arrow_udf(SCHEMA)
    def run(texts: pa.Array) -> pa.Array:
        c = coder(proto)
        rows = [c.encode(t.as_py() or "") for t in texts]
        offsets = np.cumsum([0, *(len(r[0]) // 4 for r in rows)]).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(r[0] for r in rows), np.int32)))
        return pa.StructArray.from_arrays([ids, pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int32())], names=["ids", "decoded", "n_differ"])

    return run(text)


def encode(docs: DataFrame, model: str, text: str = "text", into: str = "pieces") -> DataFrame:
    """docs with a struct column of ids, decoded text and the count of parts the library encodes otherwise."""
    with open(model, "rb") as f:
        proto = f.read()
    return docs.withColumn(into, encoded(docs[text], proto))


def digests(pieces: Column) -> list[Column]:
    """n_tokens, ids_sha256 and decoded_sha256 of an encoded column."""
    return [
        F.size(pieces["ids"]).cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", pieces["ids"].cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(pieces["decoded"], 256).alias("decoded_sha256"),
    ]
