"""Byte-level BPE: texts to token ids with character places, and back to bytes.

The ranks of a vocabulary file become a model of the tokenizers library, which the driver
builds once and ships to the tasks (its size is the vocabulary's, fixed and small). Each task
cuts a text where no match of the splitting pattern can cross, asks the library once for each
distinct piece and joins the answers. Character places come from the byte lengths of the ids.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most characters of a piece that is remembered, and most pieces remembered.
REMEMBERED, MEMORY = 40, 100_000
#: Characters of texts that are looked up together.
TOGETHER = 500_000
#: Bytes of results that travel together from a task.
SENT = 4_000_000

_PIECES = re.compile(r"[ \n\t\r]*[^ \n\t\r]+|[ \n\t\r]+")
_ODD_SPACE = re.compile(r"[^\S \n\t\r]")
_CUTS = re.compile(r"(?<=\S)(?=[ \n\t\r])")


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself where it is printable, else the next one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    later = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(later)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to id, from a file of lines ``base64 rank``."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def model_json(ranks: dict[bytes, int], pattern: str) -> str:
    """The tokenizers model that merges as the ranks say.

    A merge by ranks joins any two neighbours whose bytes together are a token, the smallest rank
    first; so every split of a token into two tokens is a merge, in the order of the tokens' ranks.
    A piece that is a token itself stays whole.
    """
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    shown = byte_characters()
    text = {token: "".join(shown[b] for b in token) for token in ranks}
    merges = [
        (text[token[:i]], text[token[i:]])
        for token in sorted(ranks, key=ranks.__getitem__)
        for i in range(1, len(token))
        if token[:i] in ranks and token[i:] in ranks
    ]
    make = lambda whole: models.BPE(vocab={text[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=whole)
    merging = make(False)  # quicker than looking for the whole piece first, and the same if each token merges to itself
    tokenizer = Tokenizer(merging if all(len(merging.tokenize(t)) == 1 for t in text.values()) else make(True))
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.Split(Regex(pattern), "isolated"),
        pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
    ])
    return tokenizer.to_str()


def token_bytes(model: str) -> dict[int, bytes]:
    """Id to bytes: the vocabulary's characters read back through the byte table."""
    back = {c: b for b, c in enumerate(byte_characters())}
    return {i: bytes(back[c] for c in token) for token, i in json.loads(model)["model"]["vocab"].items()}


def pieces(text: str) -> list[str]:
    """``text`` cut at places that no match crosses: after a character that is no white space, before one that is.

    A match of the pattern takes white space only at its start or is all white space, so the
    pieces split by themselves exactly as the whole text does.
    """
    if _ODD_SPACE.search(text):
        return [p for p in _CUTS.split(text) if p]
    return _PIECES.findall(text)


class _Encoder:
    def __init__(self, model: str, lengths: np.ndarray):
        from tokenizers import Tokenizer

        self.tokenizer, self.lengths, self.known = Tokenizer.from_str(model), lengths, {}

    def _learn(self, new: list[str]) -> None:
        """Ask the library for new pieces. Those that start but do not end with white space go
        in strings of 500: between two of them no match crosses, and byte lengths tell them apart."""
        apart = [p for p in new if p[0] not in " \n\t\r" or p[-1].isspace()]
        strings = [p for p in new if p[0] in " \n\t\r" and not p[-1].isspace()]
        groups = [[p] for p in apart] + [strings[i : i + 500] for i in range(0, len(strings), 500)]
        for at in range(0, len(groups), 4096):
            some = groups[at : at + 4096]
            for group, found in zip(some, self.tokenizer.encode_batch_fast(["".join(g) for g in some], add_special_tokens=False)):
                ids = np.array(found.ids, dtype="<u4")
                ends = np.cumsum(self.lengths[ids])
                wanted = np.cumsum([len(p.encode()) for p in group])
                cuts = np.searchsorted(ends, wanted)
                if not np.array_equal(ends[cuts], wanted):
                    raise ValueError("a token crosses two pieces")
                packed, start = ids.tobytes(), 0
                for p, end in zip(group, (4 * cuts + 4).tolist()):
                    self.known[p], start = packed[start:end], end

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, four bytes each, little-endian; the library sees each new piece of them all once."""
        parts = [pieces(t) for t in texts]
        seen = set().union(*parts)
        self._learn([p for p in seen if p not in self.known])
        out = [b"".join(map(self.known.__getitem__, p)) for p in parts]
        if len(self.known) > MEMORY:
            self.known = {p: self.known[p] for p in seen}
        for p in [p for p in seen if len(p) > REMEMBERED]:
            del self.known[p]
        return out


def character_places(text: bytes, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First character of each token and the one after its last; tokens that share a character's bytes all name it."""
    ends = np.cumsum(lengths[ids], dtype=np.int64)
    starts = ends - lengths[ids]
    character = np.cumsum((np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80) - 1
    return character[starts].astype("<u4"), (character[ends - 1] + 1).astype("<u4")


@lru_cache(1)  # kept between the tasks of a worker
def _ready(model: str, lengths: bytes) -> _Encoder:
    return _Encoder(model, np.frombuffer(lengths, dtype=np.int64))


def encode(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", places: bool = True) -> DataFrame:
    """(key, n_tokens, n_split, ids, and with ``places`` first_char, end_char) of each row's whole text.

    ``model``: see model_json. ``ids`` and the places are packed, four little-endian bytes a
    token (``numbers`` unpacks them); places count characters, the end exclusive. ``n_split``: tokens
    that start inside a character. A null or empty text has no tokens. Rows are independent, so
    repeated rows, null keys and other columns (left out) need no care; nothing is shuffled.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[key].dataType
    lengths = np.zeros(max(token_bytes(model), default=0) + 1, dtype=np.int64)
    for i, b in token_bytes(model).items():
        lengths[i] = len(b)
    names = [key, "n_tokens", "n_split", "ids", *(["first_char", "end_char"] if places else [])]

    def row(value: str, packed: bytes, lengths: np.ndarray) -> tuple:
        ids = np.frombuffer(packed, dtype="<u4")
        starts, ends = character_places(value.encode(), ids, lengths) if len(ids) else (ids, ids)
        found = len(ids), int((starts[1:] < ends[:-1]).sum()), packed
        return (*found, starts.tobytes(), ends.tobytes()) if places else found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ready(shipped.value, lengths.tobytes())
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            first, waiting, size = 0, [], 0
            for at in range(batch.num_rows):
                waiting.append(texts[at].as_py() or "")
                size += len(waiting[-1])
                if size > TOGETHER or at == batch.num_rows - 1:
                    rows = [row(value, packed, lengths) for value, packed in zip(waiting, encoder.ids(waiting))]
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), *[pa.binary()] * (len(names) - 3)))]
                    yield pa.RecordBatch.from_arrays([keys.slice(first, len(rows)), *columns], names=names)
                    first, waiting, size = at + 1, [], 0

    schema = f"`{key}` {kind.simpleString()}, n_tokens bigint, n_split bigint, " + ", ".join(f"{c} binary" for c in names[3:])
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, schema)


def decode(tokens: DataFrame, model: str, ids: str = "ids", keep: tuple[str, ...] = (), key: str = "doc_id") -> DataFrame:
    """(key, ``keep``, decoded): the bytes that packed ids stand for, characters split over tokens whole again.

    Null ids give no bytes; an id outside the vocabulary raises an error. ``keep``: columns to carry along.
    """
    shipped = tokens.sparkSession.sparkContext.broadcast(token_bytes(model))
    carried = tokens.select(key, *keep)
    names = [*carried.columns, "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shipped.value
        for batch in batches:
            *rest, packed = batch.columns
            first = 0
            while first < batch.num_rows:
                out, size = [], 0
                while first + len(out) < batch.num_rows and size < SENT:
                    out.append(b"".join(map(table.__getitem__, numbers(packed[first + len(out)].as_py() or b""))))
                    size += len(out[-1])
                yield pa.RecordBatch.from_arrays([*(c.slice(first, len(out)) for c in rest), pa.array(out, pa.binary())], names=names)
                first += len(out)

    schema = ", ".join(f"`{c}` {kind}" for c, kind in carried.dtypes) + ", decoded binary"
    return tokens.select(*carried.columns, ids).mapInArrow(run, schema)


def numbers(packed: bytes) -> list[int]:
    """The packed ids or places as numbers."""
    return np.frombuffer(packed, dtype="<u4").tolist()
