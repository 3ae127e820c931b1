"""Byte-level BPE by a lazily determinised finite-state transducer.

A prefix of the input may still be cut in several ways at its end: each hypothesis is a node of the token
trie (the bytes since its last boundary) and its last token. A state is the set of all hypotheses; reading a
byte moves each along the trie, adds the boundary that has become possible, and gives the token that ends
there. States and moves are made when first needed and kept. These tokens, each pointing back by its length,
hold every hypothesis; what all open hypotheses agree on is emitted, at the latest after a bounded number of
bytes, and the rest at the end of the match.

A boundary is possible after token t behind token l if merging the bytes of l and t by rank gives back
(l, t): then exactly one cut of every prefix passes all tests, and it is the encoder's."""

from __future__ import annotations

import base64
import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import c, claim, small_batches
from .tokens import latin_pattern, slices

#: States, remembered pair tests and remembered matches a worker; beyond each it starts anew.
MOST_STATES, MOST_PAIRS, REMEMBERED = 150_000, 500_000, 800_000
START = -1
#: Bytes after which a long match is looked at for what is certain: more than the longest token has.
LOOKAHEAD = 256


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank (= id), from a file of base64 text and number a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a piece by its merges in order of rank, leftmost first among equals."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            r = ranks.get(parts[i] + parts[i + 1])
            if r is not None and (best is None or r < best):
                best, at = r, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


class Transducer:
    def __init__(self, ranks: dict[bytes, int]):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("every byte must be a token")
        self.ranks, self.bytes_of = ranks, {i: t for t, i in ranks.items()}
        self.size_of = {i: len(t) for t, i in ranks.items()}
        self.children: list[dict[int, int]] = [{}]
        self.token_at, self.depth = [-1], [0]
        for token, rank in ranks.items():
            node = 0
            for b in token:
                nxt = self.children[node].get(b)
                if nxt is None:
                    nxt = len(self.children)
                    self.children.append({})
                    self.token_at.append(-1)
                    self.depth.append(self.depth[node] + 1)
                    self.children[node][b] = nxt
                node = nxt
            self.token_at[node] = rank
        self.pairs: dict[tuple[int, int], bool] = {}
        self._clear()

    def _clear(self) -> None:
        self.states: dict[tuple, int] = {}
        self.hypotheses: list[tuple] = []
        self.moves: list[dict[int, tuple[int, int]]] = []
        self._state(((0, START),))

    def _state(self, items: tuple) -> int:
        at = self.states.get(items)
        if at is None:
            at = self.states[items] = len(self.hypotheses)
            self.hypotheses.append(items)
            self.moves.append({})
        return at

    def follows(self, left: int, token: int) -> bool:
        """Whether token may stand behind left (START: at the beginning)."""
        key = (left, token)
        ok = self.pairs.get(key)
        if ok is None:
            if len(self.pairs) > MOST_PAIRS:
                self.pairs.clear()
            if left == START:
                ok = merged(self.bytes_of[token], self.ranks) == [token]
            else:
                ok = merged(self.bytes_of[left] + self.bytes_of[token], self.ranks) == [left, token]
            self.pairs[key] = ok
        return ok

    def _move(self, state: int, byte: int) -> tuple[int, int]:
        """(next state, the token that ends at this byte)."""
        items, boundary = [], -1
        for node, left in self.hypotheses[state]:
            nxt = self.children[node].get(byte)
            if nxt is None:
                continue
            token = self.token_at[nxt]
            if boundary < 0 and token >= 0 and self.follows(left, token):
                boundary = token
            if self.children[nxt]:
                items.append((nxt, left))
        items.append((0, boundary))
        items.sort()
        self.moves[state][byte] = got = (self._state(tuple(items)), boundary)
        return got

    def _agreed(self, state: int, ends: list[int]) -> int:
        """How many bytes all open hypotheses of the state cut alike; ends: the token that ends at each byte so far."""
        shared = None
        for node, _ in self.hypotheses[state]:
            at, cuts = len(ends) - self.depth[node], set()
            while at > 0:
                cuts.add(at)
                at -= self.size_of[ends[at - 1]]
            shared = cuts if shared is None else shared & cuts
        return max(shared or {0}, default=0)

    def _tokens(self, ends: list[int]) -> list[int]:
        at, out = len(ends), []
        while at > 0:
            token = ends[at - 1]
            out.append(token)
            at -= self.size_of[token]
        out.reverse()
        return out

    def stream(self, piece):
        """Ids of one match of the splitting pattern as they become certain; piece: its bytes, one after another."""
        if len(self.hypotheses) > MOST_STATES:
            self._clear()
        state, ends, moves = 0, [], self.moves
        for b in piece:
            move = moves[state].get(b)
            if move is None:
                move = self._move(state, b)
            state, token = move
            ends.append(token)
            if len(ends) >= LOOKAHEAD and len(ends) % LOOKAHEAD == 0:
                sure = self._agreed(state, ends)
                yield from self._tokens(ends[:sure])
                del ends[:sure]
        yield from self._tokens(ends)

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one match. A match that is a token as a whole is that token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(piece) >= LOOKAHEAD:
            return list(self.stream(piece))
        if len(self.hypotheses) > MOST_STATES:
            self._clear()
        state, ends, moves = 0, [], self.moves
        for b in piece:
            move = moves[state].get(b)
            state, token = move if move is not None else self._move(state, b)
            ends.append(token)
        return self._tokens(ends)


def _utf8_table() -> list[list[int]]:
    """states x byte classes of well-formed UTF-8: 0 between characters, 1 to 3 bytes to come, 4 to 7 a first
    continuation byte of narrower range, 8 an error."""
    table = [[8] * 256 for _ in range(9)]
    ranges = [
        (0, 0x00, 0x7F, 0), (0, 0xC2, 0xDF, 1), (0, 0xE0, 0xE0, 4), (0, 0xE1, 0xEC, 2), (0, 0xED, 0xED, 5), (0, 0xEE, 0xEF, 2),
        (0, 0xF0, 0xF0, 6), (0, 0xF1, 0xF3, 3), (0, 0xF4, 0xF4, 7), (1, 0x80, 0xBF, 0), (2, 0x80, 0xBF, 1), (3, 0x80, 0xBF, 2),
        (4, 0xA0, 0xBF, 1), (5, 0x80, 0x9F, 1), (6, 0x90, 0xBF, 2), (7, 0x80, 0x8F, 2),
    ]
    for state, low, high, to in ranges:
        for b in range(low, high + 1):
            table[state][b] = to
    return table


UTF8 = _utf8_table()


class Utf8Stream:
    """Text from bytes that come in chunks cut anywhere. Malformed bytes become U+FFFD as in errors="replace"."""

    def __init__(self):
        self.held = b""

    def feed(self, chunk: bytes) -> str:
        data = self.held + chunk
        cut = len(data)
        # An unfinished character starts at most three bytes before the end.
        for at in range(max(0, len(data) - 3), len(data)):
            state = 0
            for b in data[at:]:
                state = UTF8[state][b]
            if data[at] >= 0xC2 and state not in (0, 8):
                cut = at
                break
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def finish(self) -> str:
        rest, self.held = self.held.decode("utf-8", "replace"), b""
        return rest


class Codec:
    """encode(text) -> ids, decode(ids) -> pieces of text; matches of the pattern are encoded once each."""

    def __init__(self, path: str, pattern: str):
        import re

        import regex

        self.transducer = Transducer(load_ranks(path))
        self.find = regex.compile(pattern).findall
        self.find_latin = re.compile(latin_pattern(pattern)).findall
        size = max(self.transducer.bytes_of) + 1
        self.token_bytes = [self.transducer.bytes_of.get(i, b"") for i in range(size)]
        self.decimal = [str(i) for i in range(size)]
        self.known: dict[str, tuple[int, ...]] = {}

    def encode(self, text: str) -> list[int]:
        known, out = self.known, []
        try:
            text.encode("latin-1")
            words = self.find_latin(text)
        except UnicodeEncodeError:
            words = self.find(text)
        for word in words:
            got = known.get(word)
            if got is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                got = tuple(self.transducer.encode(word.encode("utf-8")))
                if len(word) < 64:
                    known[word] = got
            out += got
        return out

    def decode(self, ids: list[int], chunk: int = 4096):
        stream = Utf8Stream()
        for at in range(0, len(ids), chunk):
            yield stream.feed(b"".join(map(self.token_bytes.__getitem__, ids[at : at + chunk])))
        yield stream.finish()


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One a worker and vocabulary."""
    claim(_codecs)
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def bpe_ids(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """id_col, n_tokens, ids_sha256, decoded_sha256, and with_ids: ids, decoded.

    ids are those of the ranks for each match of the pattern; decoded is the text that the ids give back. A
    null text counts as empty: no ids. An empty table gives an empty result; other columns are not carried."""
    small_batches(docs.sparkSession)
    source = docs.select(c(id_col), F.coalesce(c(text_col), F.lit("")).alias("text" if id_col.lower() != "text" else "_text"))
    fields = [T.StructField(id_col, source.schema[0].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if with_ids:
        fields += [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]

    def run(batches):
        import pyarrow as pa

        c = codec(ranks, pattern)
        for batch in batches:
            for at, texts in slices(batch.column(1)):
                n, ids_sha, text_sha, all_ids, decoded = [], [], [], [], []
                for text in texts:
                    ids = c.encode(text)
                    n.append(len(ids))
                    ids_sha.append(hashlib.sha256(" ".join(map(c.decimal.__getitem__, ids)).encode()).hexdigest())
                    sha, parts = hashlib.sha256(), []
                    for part in c.decode(ids):
                        sha.update(part.encode("utf-8"))
                        if with_ids:
                            parts.append(part)
                    text_sha.append(sha.hexdigest())
                    if with_ids:
                        all_ids.append(ids)
                        decoded.append("".join(parts))
                out = [batch.column(0).slice(at, len(texts)), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
                if with_ids:
                    out += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(out, names=[f.name for f in fields])

    return source.mapInArrow(run, T.StructType(fields))


def op7_bpe_transducer(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return bpe_ids(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, with_ids=False)
