"""SentencePiece BPE by a prefix table instead of a merge queue, and decoding with the library.

A text's ids are fixed by a local rule: tokens t1 .. tn are the encoding if and only if every neighbouring pair is the
encoding of its own concatenation. So every prefix of a text has one last token: the token among those that end there
(found by an automaton over all pieces) which the last token of the prefix before it tolerates as a neighbour. The ids
follow backwards from the last prefix. Whether two tokens tolerate each other is found once, by merging the two alone.

No piece holds a space mark behind another character, so a text falls into units, each a run of marks and what follows,
and a task keeps the ids of the units it has met. Where pieces share a merge rank (runs of marks), merges depend on
the place, and the unit goes through the merge queue.
"""
from __future__ import annotations

import hashlib
import heapq
import operator
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from itembank.llm.common import query, slices, table
from itembank.llm.vocab import tokenizer_path

MARK = "▁"
#: What a task remembers before it starts anew: units with their ids, pairs of tokens with the answer.
UNITS = 200_000
PAIRS = 1_500_000
#: Longer units are encoded each time.
KEPT_LENGTH = 64
UNIT = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")

_loaded: dict[str, "PrefixTable"] = {}


class PrefixTable:
    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=path)
        self.rank: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        byte_ids = {}
        for i in range(self.library.vocab_size()):
            piece = self.library.id_to_piece(i)
            if self.library.is_byte(i):
                byte_ids[int(piece[3:5], 16)] = i
            elif not (self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_unused(i)):
                self.rank[piece], self.ids[piece] = self.library.get_score(i), i
        if len(byte_ids) != 256:
            raise ValueError("a model with byte fallback is needed")
        self.byte_ids = [byte_ids[b] for b in range(256)]
        self.cut = not any(MARK in p.lstrip(MARK) for p in self.rank)
        shared = Counter(self.rank.values())
        #: Pieces whose rank is not theirs alone.
        tied = [p for p in self.rank if len(p) > 1 and shared[self.rank[p]] > 1]
        self.tied = re.compile("|".join(map(re.escape, tied))) if tied else None
        self.automaton = ahocorasick.Automaton()
        for piece in self.rank:
            self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()
        self.chars = {p for p in self.rank if len(p) == 1}
        #: Neighbouring characters of some piece; between any others, no merge reaches.
        self.inside = {a + b for p in self.rank for a, b in zip(p, p[1:])}
        self.pairs: defaultdict[str, dict[str, bool]] = defaultdict(dict)
        self.n_pairs = 0
        self.parts: dict[str, bytes] = {}
        self.units: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """The tokens that the merge queue leaves of ``text``: highest rank first, then leftmost."""
        parts: list[str | None] = list(text)
        right, left = [*range(1, len(parts)), -1], [*range(-1, len(parts) - 1)]
        queue = [(-self.rank[a + b], i, a, b) for i, (a, b) in enumerate(zip(text, text[1:])) if a + b in self.rank]
        heapq.heapify(queue)
        while queue:
            _, i, a, b = heapq.heappop(queue)
            j = right[i]
            if parts[i] != a or j < 0 or parts[j] != b:
                continue
            parts[i], parts[j], right[i] = a + b, None, right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for k in (left[i], i):
                if k >= 0 and right[k] >= 0 and (pair := parts[k] + parts[right[k]]) in self.rank:
                    heapq.heappush(queue, (-self.rank[pair], k, parts[k], parts[right[k]]))
        return [p for p in parts if p is not None]

    def tolerates(self, before: str, token: str) -> bool:
        """Whether ``token`` can stand behind ``before`` ("": at the start)."""
        if self.n_pairs >= PAIRS:
            self.pairs.clear()
            self.n_pairs = 0
        known = self.merged(before + token) == ([before, token] if before else [token])
        self.pairs[before][token] = known
        self.n_pairs += 1
        return known

    def tokens(self, unit: str) -> list[str]:
        """Tokens of one unit; characters without a piece stand for themselves."""
        if self.tied and self.tied.search(unit):
            return self.merged(unit)
        pairs, last = self.pairs, [""] * (len(unit) + 1)
        matches = self.automaton.iter(unit)
        if not self.chars.issuperset(unit):
            matches = heapq.merge(matches, ((i, c) for i, c in enumerate(unit) if c not in self.chars))
        for end, token in matches:
            if last[end + 1]:
                continue
            before = last[end + 1 - len(token)]
            known = pairs[before].get(token)
            if known is None:
                known = self.tolerates(before, token)
            if known:
                last[end + 1] = token
        out, end = [], len(unit)
        while end:
            out.append(last[end])
            end -= len(last[end])
        return out[::-1]

    def unit_ids(self, unit: str) -> bytes:
        """Ids of a unit, cut where no piece has the two characters side by side."""
        inside, out, start = self.inside, [], 0
        for end, pair in enumerate(map(operator.add, unit, unit[1:]), 1):
            if pair not in inside:
                out.append(self.part_ids(unit[start:end]))
                start = end
        out.append(self.part_ids(unit[start:]))
        return b"".join(out)

    def part_ids(self, part: str) -> bytes:
        known = self.parts.get(part)
        if known is None:
            ids: list[int] = []
            for token in self.tokens(part):
                if token in self.ids:
                    ids.append(self.ids[token])
                else:
                    ids += [self.byte_ids[b] for b in token.encode("utf-8", "surrogatepass")]
            known = np.array(ids, "<i4").tobytes()
            if len(part) <= KEPT_LENGTH:
                self.parts[part] = known
        return known

    def encode(self, text: str) -> bytes:
        """Ids of ``text`` as little-endian 32-bit integers."""
        if not text:
            return b""
        if len(self.units) + len(self.spaced) > UNITS:
            self.units.clear()
            self.spaced.clear()
        if len(self.parts) > UNITS:
            self.parts.clear()
        plain = self.cut and MARK not in text and "  " not in text and text[0] != " " and text[-1] != " "
        if plain:
            known, parts = self.spaced, text.split(" ")
            for part in set(parts).difference(known):
                known[part] = self.unit_ids(MARK + part)
            return b"".join(map(known.__getitem__, parts))
        marked = MARK + text.replace(" ", MARK)
        out = []
        for unit in UNIT.findall(marked) if self.cut else [marked]:
            ids = self.units.get(unit)
            if ids is None:
                ids = self.unit_ids(unit)
                if len(unit) <= KEPT_LENGTH:
                    self.units[unit] = ids
            out.append(ids)
        return b"".join(out)


def coder(path: str) -> PrefixTable:
    if path not in _loaded:
        _loaded[path] = PrefixTable(path)
    return _loaded[path]


#: What ``encode_decode`` can return beside the columns of its input.
OUTPUTS = {
    "n_tokens": "long", "ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string",
}


def _run(model: str, model_path: str | None, text: str, kept: list[str], outputs: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = coder(model_path or tokenizer_path(model))
        decimal = [str(i) for i in range(table.library.vocab_size())].__getitem__
        decode = "decoded" in outputs or "decoded_sha256" in outputs
        for part in slices(batches, text):
            made: dict[str, list] = {c: [] for c in outputs}
            for content in part.column(text).to_pylist():
                ids = np.frombuffer(table.encode(content or ""), "<i4").tolist()
                decoded = table.library.decode(ids) if decode and ids else ""
                for column, values in made.items():
                    values.append(
                        len(ids) if column == "n_tokens" else ids if column == "ids" else decoded if column == "decoded"
                        else hashlib.sha256((",".join(map(decimal, ids)) if column == "ids_sha256" else decoded).encode()).hexdigest())
            types = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32())}
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in kept), *(pa.array(v, types.get(c, pa.string())) for c, v in made.items())], [*kept, *outputs])

    return run


def encode_decode(
    docs: DataFrame, keep: list[str], outputs: list[str], model: str = "piece_bpe_32k.model", model_path: str | None = None,
    text: str = "text",
) -> DataFrame:
    """Columns ``keep`` of every row with ``outputs`` (see OUTPUTS) of its whole text; no shuffle.

    Ids are exactly those of the library without begin and end ids; ``decoded`` is the library's decode(ids). A null or
    empty text has no ids and decodes to "". Rows that repeat, ties and other columns make no difference.
    """
    read = list(dict.fromkeys([*keep, text]))
    schema = StructType([docs.schema[c] for c in keep]).simpleString()[7:-1]
    made = ",".join(f"{c}:{OUTPUTS[c]}" for c in outputs)
    fields = StructType.fromDDL(",".join(filter(None, [schema, made])))
    return docs.select(*[F.col(c) for c in read]).mapInArrow(_run(model, model_path, text, keep, outputs), fields)


@query()
def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents, encoded and decoded."""
    return encode_decode(table(spark, sf_dir, "documents"), ["doc_id"], ["n_tokens", "ids_sha256", "decoded_sha256"])
