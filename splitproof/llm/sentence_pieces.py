"""SentencePiece BPE encoding and decoding by a merge-type prefix table.

Byte-pair encoding has two properties that this encoder builds on. The encoding of a text, cut after any of its
tokens, is the encoding of the text up to there; and a row of tokens is an encoding if each token encodes to
itself and each adjacent pair encodes to itself. So every prefix of a text has a unique last token. An
automaton over the vocabulary finds the tokens that end at a position; the one that is compatible with the last
token of the prefix before it is stored; the ids are then recovered from the end backwards. Work grows with the
length of the text, whatever the text is.

Two tokens are compatible if no merge across their boundary comes before the merges that complete them, which a
walk up the right side of the first token's merge tree and the left side of the second's decides.

The model's normalisation must be the identity with a dummy prefix (checked when the table is built). Characters
without a piece become their UTF-8 bytes' pieces. Texts are encoded in chunks cut where no piece can span; the
results of short chunks are kept in a bounded memo in each Python worker. The short chunks of a block of texts that
the memo doesn't hold fill their tables together, position by position, in numpy.

Defined cases: a null text is encoded as the empty text: no ids. Repeated rows are each encoded. Further columns
are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from dataclasses import dataclass
from functools import cached_property
from itertools import chain

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import releasing, small_batches

SPACE = "▁"
MEMO = 120_000  # chunks in each half of what a Python worker keeps
MEMO_CHARS = 40  # of a chunk that is kept
PAIR_BITS = 21  # slots for pair tests kept by a Python worker, as a power of two; a later pair takes over its slot
BLOCK_TEXTS, BLOCK_CHARS = 256, 1 << 18  # of the texts that are encoded together; a longer text goes alone
TABLE_CHUNKS = 1 << 13  # chunks whose tables are filled together
FAR = 1 << 60


def merge_by_rank(symbols: list[str], rank: dict[str, int]) -> list[tuple[str, int]]:
    """Plain BPE: join the adjacent pair whose piece ranks best, the leftmost first, until none is left.

    Returns the pieces with the rank at which each was made (-1 for single characters). Used to lay down merge
    trees when the table is built, never on texts.
    """
    n = len(symbols)
    text, made = list(symbols), [-1] * n
    left, right, alive = list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
    heap: list[tuple[int, int, str]] = []

    def offer(i: int) -> None:
        if i >= 0 and right[i] >= 0:
            joined = text[i] + text[right[i]]
            if joined in rank:
                heapq.heappush(heap, (rank[joined], i, joined))

    for i in range(n - 1):
        offer(i)
    while heap:
        r, i, joined = heapq.heappop(heap)
        j = right[i] if alive[i] else -1
        if j < 0 or text[i] + text[j] != joined:
            continue
        text[i], made[i], alive[j], right[i] = joined, r, False, right[j]
        if right[j] >= 0:
            left[right[j]] = i
        offer(i)
        offer(left[i])
    return [(text[i], made[i]) for i in range(n) if alive[i]]


class States:
    """The vocabulary's automaton in arrays, so that many texts take a step at once.

    ``ends``: of a state, the state of the longest token that ends there (0: none); ``shorter``: of a token's state, that
    of the next shorter one; ``token``: its id.
    """

    SLOTS = 20  # of the table of children, as a power of two

    def __init__(self, pieces: list[str], ids: list[int]):
        letters = sorted(set("".join(pieces[i] for i in ids)))
        number = {c: k for k, c in enumerate(letters, 1)}
        self.code = np.zeros(0x110000, np.int32)  # 0: in no token
        self.code[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.width = len(letters) + 1
        child: dict[int, int] = {}
        parent, letter, depth, token = [0], [0], [0], [-1]
        for i in ids:
            at = 0
            for c in pieces[i]:
                key = at * self.width + number[c]
                to = child.get(key)
                if to is None:
                    to = child[key] = len(token)
                    parent.append(at)
                    letter.append(number[c])
                    depth.append(depth[at] + 1)
                    token.append(-1)
                at = to
            token[at] = i
        n = len(token)
        fail, ends, shorter = [0] * n, [0] * n, [0] * n
        for at in sorted(range(1, n), key=depth.__getitem__):
            back = parent[at]
            while back:
                back = fail[back]
                to = child.get(back * self.width + letter[at])
                if to is not None:
                    fail[at] = to
                    break
            shorter[at] = ends[fail[at]]
            ends[at] = at if token[at] >= 0 else shorter[at]
        self.token, self.fail, self.ends, self.shorter = (np.array(x, np.int64) for x in (token, fail, ends, shorter))
        self.first = np.zeros(self.width, np.int64)  # children of the start
        for k in range(1, self.width):
            self.first[k] = child.get(k, 0)
        keys = np.fromiter(child, np.int64, len(child))
        to = np.fromiter(child.values(), np.int64, len(child))
        self.keys, self.to = np.full(1 << self.SLOTS, -1, np.int64), np.zeros(1 << self.SLOTS, np.int32)
        slot = self._slot(keys)
        while len(keys):  # a key whose slot is taken goes to the next
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[free]
            mine = self.keys[slot] == keys
            self.to[slot[mine]] = to[mine]
            keys, to, slot = keys[~mine], to[~mine], (slot[~mine] + 1) & ((1 << self.SLOTS) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.SLOTS)).view(np.int64)

    def child(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The state that a character leads on to, 0 if there is none."""
        key = state * self.width + code
        slot = self._slot(key)
        held = self.keys[slot]
        out = np.where(held == key, self.to[slot], 0)
        rest = np.flatnonzero((held != key) & (held >= 0))
        while len(rest):
            slot[rest] = (slot[rest] + 1) & ((1 << self.SLOTS) - 1)
            held = self.keys[slot[rest]]
            hit = held == key[rest]
            out[rest[hit]] = self.to[slot[rest[hit]]]
            rest = rest[~hit & (held >= 0)]
        return out

    def advance(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        out = self.first[code]
        at = np.flatnonzero(state)
        now = state[at]
        while len(at):
            to = self.child(now, code[at])
            hit = to > 0
            out[at[hit]] = to[hit]
            now = self.fail[now[~hit]]
            at = at[~hit][now > 0]
            now = now[now > 0]
        return out


@dataclass
class PieceTable:
    """What an executor needs of a model; independent of the library."""

    pieces: list[str]
    piece_id: dict[str, int]
    bytes_id: list[int]
    rank: dict[str, int]
    left_spine: dict[int, tuple[tuple[str, int], ...]]  # of a token: (piece, rank of the merge that ends it), from the first character up
    right_spine: dict[int, tuple[tuple[str, int], ...]]
    chunks: str  # pattern of the chunks that are encoded on their own
    automaton: object = None

    @classmethod
    def load(cls, path: str) -> PieceTable:
        """Read a BPE model with byte fallback."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        probe = " a  éﬁ① b\t"
        if sp.normalize(probe) != SPACE + probe.replace(" ", SPACE):
            raise ValueError("only models with identity normalisation and a dummy prefix are supported")
        n = sp.vocab_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(n)]
        bytes_id = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if not all(sp.is_byte(i) for i in bytes_id):
            raise ValueError("only models with byte fallback are supported")
        piece_id = {p: i for i, p in enumerate(pieces) if not special[i]}
        order = sorted((i for i in piece_id.values() if len(pieces[i]) > 1), key=lambda i: -sp.get_score(i))
        rank = {pieces[i]: r for r, i in enumerate(order)}
        left, right, spanned = {}, {}, set()
        kept: dict = {p: p for p in piece_id}  # strings and pairs that many spines share are held once
        share = lambda spine: tuple(kept.setdefault(e, e) for e in ((kept.setdefault(p, p), due) for p, due in spine))
        for p, i in piece_id.items():
            trees = _spines(p, rank)
            if trees is not None:
                left[i], right[i] = map(share, trees)
            if len(p) > 1:
                spanned.update(p)
        inner = any(SPACE in p.lstrip(SPACE) for p in piece_id)
        alone = "\n" if "\n" not in spanned else ""
        chunks = "(?s).+" if inner else (f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" + ("|\n" if alone else ""))
        return cls(pieces, piece_id, bytes_id, rank, left, right, chunks)

    def prepare(self) -> None:
        """Build the automaton; it is not sent with the table."""
        a = ahocorasick.Automaton()
        for i in self.left_spine:
            a.add_word(self.pieces[i], i)
        a.make_automaton()
        self.automaton = a
        self.lengths = [len(p) for p in self.pieces]
        self.length = np.array(self.lengths)
        self.names = np.array([str(i) for i in range(len(self.pieces))], object)
        self.shown = np.array([p.replace(SPACE, " ") for p in self.pieces], object)
        self.bits = len(self.pieces).bit_length()
        self.pair_key = np.full(1 << PAIR_BITS, -1, np.int64)
        self.pair_fits = np.zeros(1 << PAIR_BITS, bool)
        self.memo = _Memo(self)
        self.split = re.compile(self.chunks).findall

    def put_down(self) -> None:
        """Free what prepare() has built: a Python worker keeps the broadcast table after its task."""
        self.automaton = self.pair_key = self.pair_fits = self.memo = None
        self.names = self.shown = self.lengths = self.length = None

    def compatible(self, a: int, b: int) -> bool:
        """Whether the texts of two tokens, put together, encode to these two tokens."""
        up, down, i, j, rank = self.right_spine[a], self.left_spine[b], 0, 0, self.rank
        while True:
            x, grow_x = up[i]
            y, grow_y = down[j]
            across = rank.get(x + y, FAR)
            if across < FAR and across < grow_x and across <= grow_y:
                return False
            if grow_x == FAR and grow_y == FAR:
                return True
            if grow_x <= grow_y:
                i += 1
            else:
                j += 1

    def all_compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """compatible() of each pair, by the tests kept where they are."""
        key = a << self.bits | b
        slot = (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - PAIR_BITS)).view(np.int64)
        out = self.pair_fits[slot]
        new = np.flatnonzero(self.pair_key[slot] != key)
        if len(new):
            keys, first, back = np.unique(key[new], return_index=True, return_inverse=True)
            first = new[first]
            fits = np.fromiter(map(self.compatible, a[first].tolist(), b[first].tolist()), bool, len(keys))
            out[new] = fits[back]
            # two keys of one slot: both arrays are set in the same order, so the last one holds in both
            self.pair_key[slot[first]], self.pair_fits[slot[first]] = keys, fits
        return out

    def encode_chunk(self, chunk: str) -> list[int]:
        """Ids of one chunk: fill the table of last tokens, then walk it backwards."""
        n = len(chunk)
        last = [-1] * (n + 1)  # last token of the prefix that ends here; -1 at the start and after a character without a piece
        tests: dict[tuple[int, int], bool] = {}
        lengths = self.lengths
        for end, token in self.automaton.iter(chunk):
            end += 1
            if last[end] >= 0:
                continue
            before = last[end - lengths[token]]
            if before >= 0:
                fits = tests.get((before, token))
                if fits is None:
                    fits = self.compatible(before, token)
                    if len(tests) < TABLE_CHUNKS:
                        tests[before, token] = fits
                if not fits:
                    continue
            last[end] = token
        ids: list[int] = []
        while n > 0:
            token = last[n]
            if token < 0:
                ids.extend(self.bytes_id[b] for b in reversed(chunk[n - 1].encode()))
                n -= 1
            else:
                ids.append(token)
                n -= lengths[token]
        ids.reverse()
        return ids

    @cached_property
    def states(self) -> States:
        return States(self.pieces, list(self.left_spine))

    def encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all chunks, how many each has, whether it has a character without a piece: its ids don't count).

        The same tables as encode_chunk()'s, filled for all chunks at once: first the prefixes of one character, then of
        two, and so on; of the tokens that end at a place the longest is tested first.
        """
        size = np.fromiter(map(len, chunks), np.int64, len(chunks))
        order = np.argsort(-size, kind="stable")  # so that those with a character at a place come first
        size = size[order]
        auto, width = self.states, int(size[0])
        text = np.frombuffer("".join([chunks[i] for i in order.tolist()]).encode("utf-32-le", "surrogatepass"), "<u4")
        codes = np.zeros((len(chunks), width), np.int64)
        codes[np.arange(width) < size[:, None]] = auto.code[text]
        codes = np.ascontiguousarray(codes.T)
        last = np.full((width + 1, len(chunks)), -1, np.int64)
        state = np.zeros(len(chunks), np.int64)
        for p, n in enumerate(np.searchsorted(-size, -np.arange(width), "left").tolist()):
            state = auto.advance(state[:n], codes[p, :n])
            node = auto.ends[state]
            at = np.flatnonzero(node)
            node = node[at]
            while len(at):
                t = auto.token[node]
                before = last[p + 1 - self.length[t], at]
                fits = before < 0
                tested = np.flatnonzero(~fits)
                fits[tested] = self.all_compatible(before[tested], t[tested])
                last[p + 1, at[fits]] = t[fits]
                node = auto.shorter[node]
                go = ~fits & (node > 0)
                at, node = at[go], node[go]
        place, live = size.copy(), np.flatnonzero(size)
        odd = np.zeros(len(chunks), bool)
        owners, tokens = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        while len(live):
            t = last[place[live], live]
            odd[order[live[t < 0]]] = True
            live, t = live[t >= 0], t[t >= 0]
            owners.append(order[live])
            tokens.append(t)
            place[live] -= self.length[t]
            live = live[place[live] > 0]
        owner, ids = np.concatenate(owners)[::-1], np.concatenate(tokens)[::-1]
        return ids[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(chunks)), odd

    def chunks_of(self, text: str) -> list[str]:
        return self.split(SPACE + text.replace(" ", SPACE)) if text else []

    def encode(self, text: str) -> list[int]:
        return [i for chunk in self.chunks_of(text) for i in self.encode_chunk(chunk)]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces with spaces restored, byte pieces joined to characters, the dummy prefix dropped."""
        out = self._surface(ids)
        return out[1:] if ids and self.pieces[ids[0]].startswith(SPACE) else out

    def _surface(self, ids: list[int]) -> str:
        parts: list[str] = []
        raw = bytearray()
        first = self.bytes_id[0]
        for i in ids:
            if first <= i < first + 256 and self.bytes_id[i - first] == i:
                raw.append(i - first)
                continue
            if raw:
                parts.append(_characters(bytes(raw)))
                raw.clear()
            parts.append(self.pieces[i])
        text = "".join(parts).replace(SPACE, " ")
        return text + _characters(bytes(raw)) if raw else text

    def entry(self, chunk: str) -> tuple[str, str]:
        """Ids of a chunk, comma-joined, and its decoded surface."""
        ids = self.encode_chunk(chunk)
        return ",".join(map(str, ids)), self._surface(ids)

    def entries(self, chunks: list[str]) -> list[tuple[str, str]]:
        """entry() of many short chunks."""
        ids, counts, odd = self.encode_chunks(chunks)
        names, shown = self.names[ids].tolist(), self.shown[ids].tolist()
        ends = np.cumsum(counts)
        out = [
            (",".join(names[a:b]), "".join(shown[a:b])) for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True)
        ]
        for i in np.flatnonzero(odd).tolist():
            out[i] = self.entry(chunks[i])
        return out

    def round_trips(self, texts: list[str | None]) -> list[tuple[str, str]]:
        """(comma-joined ids, decoded text) of each whole text."""
        cut = [self.chunks_of(t or "") for t in texts]
        self.memo.learn(set(chain.from_iterable(cut)))
        out = []
        for chunks in cut:
            if chunks:
                ids, surfaces = zip(*map(self.memo.__getitem__, chunks), strict=True)
                out.append((",".join(ids), "".join(surfaces)[1:]))
            else:
                out.append(("", ""))
        return out

    def round_trip(self, text: str | None) -> tuple[str, str]:
        return self.round_trips([text])[0]


class _Memo(dict):
    """Entries of chunks in two halves: what is in use comes over from the older half as it is met again."""

    def __init__(self, table: PieceTable):
        super().__init__()
        self.table, self.older = table, {}

    def learn(self, chunks: set[str]) -> None:
        """Have the entries of short chunks at hand."""
        if len(self) >= MEMO:
            self.older = dict(self)
            self.clear()
        new = []
        for c in [c for c in chunks if c not in self]:
            known = self.older.get(c)
            if known is not None:
                self[c] = known
            elif len(c) <= MEMO_CHARS:
                new.append(c)
        for i in range(0, len(new), TABLE_CHUNKS):
            some = new[i : i + TABLE_CHUNKS]
            self.update(zip(some, self.table.entries(some), strict=True))

    def __missing__(self, chunk: str) -> tuple[str, str]:
        return self.table.entry(chunk)  # a long one, which isn't kept


def _blocks(texts: list[str | None]):
    """Slices of texts that are encoded together."""
    begin = chars = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > begin and (i - begin >= BLOCK_TEXTS or chars + n > BLOCK_CHARS):
            yield begin, i
            begin, chars = i, 0
        chars += n
    if begin < len(texts):
        yield begin, len(texts)


def _characters(raw: bytes) -> str:
    """Bytes as UTF-8; each byte that is part of no character becomes U+FFFD."""
    out, i = [], 0
    while i < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[i : i + n].decode())
                i += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            i += 1
    return "".join(out)


def _spines(piece: str, rank: dict[str, int]):
    """Left and right side of a piece's merge tree, or None if BPE doesn't make this piece of its text.

    Each entry: a piece on that side and the rank by which it is merged on (FAR for the whole piece); a merge that
    had to wait for its parts counts with the worst rank among them.
    """
    text = list(piece)
    tree: dict[tuple[int, int], int] = {}
    n = len(text)
    if n == 1:
        return (((piece, FAR),), ((piece, FAR),))
    spans = [(i, i + 1) for i in range(n)]
    due = {s: -1 for s in spans}
    while len(spans) > 1:
        options = [
            (rank[piece[a[0] : b[1]]], i) for i, (a, b) in enumerate(zip(spans, spans[1:], strict=False)) if piece[a[0] : b[1]] in rank
        ]
        if not options:
            return None
        r, i = min(options)
        a, b = spans[i], spans[i + 1]
        joined = (a[0], b[1])
        due[joined] = max(r, due[a], due[b])
        tree[a] = tree[b] = due[joined]
        spans[i : i + 2] = [joined]
    at_left = sorted((s for s in due if s[0] == 0), key=lambda s: s[1])
    at_right = sorted((s for s in due if s[1] == n), key=lambda s: -s[0])
    side = lambda spans_: tuple((piece[a:b], tree.get((a, b), FAR)) for a, b in spans_)
    return side(at_left), side(at_right)



def round_trips(docs: DataFrame, model_path: str, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 of each text; with_ids adds ids (array).

    The table is built on the driver and broadcast: its size is the vocabulary's, whatever the input.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(PieceTable.load(model_path))
    schema = "id string, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if with_ids:
        schema += ", ids array<int>"

    def run(batches):
        table = shared.value
        if table.automaton is None:
            table.prepare()
        digest = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        names = ["n_tokens", "ids_sha256", "decoded_sha256", "ids"][: 4 if with_ids else 3]
        for pdf in batches:
            texts = pdf["text"].tolist()
            for begin, end in _blocks(texts):
                rows: list[tuple] = []
                for ids, decoded in table.round_trips(texts[begin:end]):
                    row = (ids.count(",") + 1 if ids else 0, digest(ids), digest(decoded))
                    rows.append((*row, np.fromstring(ids, np.int32, sep=",")) if with_ids else row)
                out = pd.DataFrame(rows, columns=names)
                out.insert(0, "id", pdf["id"].to_numpy()[begin:end])
                yield out
        table.put_down()

    rows = docs.select(F.col(id_col).cast("string").alias("id"), "text")  # as text: pandas has no whole numbers with nulls
    out = rows.mapInPandas(releasing(run), schema)
    return out.select(F.col("id").cast("long").alias(id_col), *out.columns[1:])


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op8_sentence_pieces(spark, sf_dir: str) -> DataFrame:
    return round_trips(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), default_model())
