"""Byte-level BPE by dynamic programming over prefixes.

For every prefix of a piece's bytes there is one token that can end its encoding;
`last[i]` stores that token for the first i bytes.  A token may end prefix i if it
is a suffix of those bytes and does not merge with the token that ends what is
left, which `Merges.adjoin` decides from the merge table alone.  So bytes can be
appended by going on from the old prefixes (`Prefixes.append`), and a changed
piece is encoded again only from the first changed byte (`Prefixes.edit`).

Defined cases: a null text counts as empty; an empty text has no ids and decodes to
no bytes; special tokens in a text are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Distinct pieces that one Python worker remembers, and keeps while other stages run in it; older ones are worked out again.
CACHE_PIECES = 400_000


class Merges:
    """Ranks, and for every token the pair that its last merge joins."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.size = 1 + max(ranks.values())
        self.bytes_of = [b""] * self.size
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        #: for the last two bytes of a prefix: lengths of the tokens that end so, longest first
        lengths: dict[bytes, set[int]] = {}
        for token in ranks:
            if len(token) > 1:
                lengths.setdefault(token[-2:], set()).add(len(token))
        self.lengths = {k: tuple(sorted(v, reverse=True)) for k, v in lengths.items()}
        self.halves: list[tuple[int, int] | None] = [None] * self.size
        self.joined: dict[tuple[int, int], int] = {}
        self.known: dict[tuple[int, int], bool] = {}
        for token, rank in ranks.items():
            if len(token) > 1 and (pair := self._last_merge(token, rank)):
                self.halves[rank] = pair
                self.joined[pair] = rank

    def _last_merge(self, token: bytes, below: int) -> tuple[int, int] | None:
        parts = [token[i : i + 1] for i in range(len(token))]
        get = self.ranks.get
        while len(parts) > 2:
            best, at = below, -1
            for i in range(len(parts) - 1):
                r = get(parts[i] + parts[i + 1], below)
                if r < best:
                    best, at = r, i
            if at < 0:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        a, b = get(parts[0]), get(parts[1])
        return None if a is None or b is None else (a, b)

    def adjoin(self, left: int, right: int) -> bool:
        """Whether the two tokens stay apart when their bytes are encoded together.

        The merges of either side are undone from the latest on; the tokens stay
        apart if at no moment the two that touch would have merged first.
        """
        key = (left, right)
        known = self.known.get(key)
        if known is not None:
            return known
        answer, before = True, self.size
        a, b = left, right
        while True:
            rank = self.joined.get((a, b))
            if rank is not None and rank < before:
                answer = False
                break
            inner_a, inner_b = self.halves[a], self.halves[b]
            # undo the later of the two merges; a base token has none
            if inner_a and (a > b or not inner_b):
                if not inner_b or a > b:
                    before, a = a, inner_a[1]
                    continue
            if inner_b:
                before, b = b + 1, inner_b[0]
                continue
            break
        if len(self.known) > 2_000_000:
            self.known.clear()
        self.known[key] = answer
        return answer


class Prefixes:
    """The last tokens of every prefix of some bytes."""

    def __init__(self, merges: Merges, data: bytes = b""):
        self.merges, self.data, self.last = merges, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> "Prefixes":
        m, last = self.merges, self.last
        self.data = data = self.data + more
        get, known, adjoin, lengths = m.ranks.get, m.known.get, m.adjoin, m.lengths.get
        for end in range(len(last), len(data) + 1):
            found = get(data[end - 1 : end])
            for length in lengths(data[end - 2 : end], ()) if end > 1 else ():
                if length > end:
                    continue
                token = get(data[end - length : end])
                if token is None:
                    continue
                if length == end:
                    found = token
                    break
                before = last[end - length]
                fits = known((before, token))
                if fits or (fits is None and adjoin(before, token)):
                    found = token
                    break
            # every prefix has one valid last token: if no longer one fits, it is the byte's own
            last.append(found)
        return self

    def edit(self, data: bytes) -> "Prefixes":
        """As if made from `data`, but keeping the prefixes that did not change."""
        same, most = 0, min(len(data), len(self.data))
        while same < most and data[same] == self.data[same]:
            same += 1
        del self.last[same + 1 :]
        self.data = data[:same]
        return self.append(data[same:])

    def ids(self) -> list[int]:
        out, at = [], len(self.data)
        while at:
            out.append(self.last[at])
            at -= len(self.merges.bytes_of[out[-1]])
        return out[::-1]


@lru_cache(maxsize=2)
def load(path: str) -> Merges:
    with open(path, "rb") as f:
        return Merges({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


class Codec:
    """Encodes and decodes whole texts; `ids` of pieces seen before come from a bounded memory."""

    def __init__(self, path: str, pattern: str):
        self.merges, self.split = load(path), regex.compile(pattern).findall
        self.young: dict[str, str] = {}
        self.old: dict[str, str] = {}
        self.number = {str(i): b for i, b in enumerate(self.merges.bytes_of)}

    def piece(self, piece: str) -> str:
        found = self.old.get(piece)
        if found is None:
            raw = piece.encode()
            whole = self.merges.ranks.get(raw)
            found = str(whole) if whole is not None else " ".join(map(str, Prefixes(self.merges, raw).ids()))
        if len(self.young) >= CACHE_PIECES // 2:
            self.old, self.young = self.young, {}
        self.young[piece] = found
        return found

    def encode(self, text: str) -> str:
        """Decimal ids joined by spaces."""
        pieces = self.split(text)
        out = list(map(self.young.get, pieces))
        if None in out:
            out = [x or self.young.get(p) or self.piece(p) for x, p in zip(out, pieces, strict=True)]
        return " ".join(out)

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.number.__getitem__, ids.split()))


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    key = (path, pattern)
    if key not in _codecs:
        _codecs[key] = Codec(path, pattern)
    return _codecs[key]


def encode(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids, the decimal string, and decoded text) of each row.

    Rows are independent: no shuffle.  Null texts count as empty; columns besides doc_id and text are ignored.
    """

    def run(batches):
        c = codec(path, pattern)
        for batch in batches:
            texts = batch.column(1)
            counts, digests, backs, all_ids, all_texts = [], [], [], [], []
            for x in texts:
                text = x.as_py() or ""
                ids = c.encode(text)
                back = c.decode(ids)
                counts.append(ids.count(" ") + 1 if ids else 0)
                digests.append(hashlib.sha256(ids.encode()).hexdigest())
                backs.append(hashlib.sha256(back).hexdigest())
                if with_ids:
                    all_ids.append(ids)
                    all_texts.append(back.decode())
            out = [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(backs, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                out += [pa.array(all_ids, pa.string()), pa.array(all_texts, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(out, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, schema + (", ids string, decoded string" if with_ids else ""))
