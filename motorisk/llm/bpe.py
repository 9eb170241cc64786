"""Operator 5: BPE encoding and decoding.

The tokenizer's definition file (normaliser, split pattern, vocabulary, merges)
is read on the driver once and shipped as a bounded broadcast. Frequent words of the corpus
(counted over all documents) are compiled with their ids into a minimal
acyclic automaton whose suffixes are shared; tasks memory-map it. A word of
the text is looked up in the automaton; a word outside it is merged exactly.
The lexicon changes the speed, never the ids.

Defined cases: null text encodes as empty text (no ids); the strings of added
tokens inside a text become those tokens, as the tokenizers library does by
default; long texts are encoded whole; rows are independent, so repeated rows
and ties need no rule; an empty table gives an empty table; all input columns
are kept and a new column never replaces one (clashing names get a leading
underscore, see ``encode``)."""

from __future__ import annotations

import heapq
import json
import mmap
import re
import tempfile
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Stages

#: Frequent words in the automaton; bounds its size, hence the broadcast (about 3 MB).
LEXICON_WORDS = 65_536
#: Longest word in the automaton, in characters; longer ones are always merged.
LEXICON_WORD_CHARS = 40
#: Chunks a task remembers before it starts over; longer chunks are never remembered.
MEMO_CHUNKS, MEMO_CHUNK_CHARS = 250_000, 64
#: Distinct words a counting task holds before it passes its counts on.
COUNT_WORDS = 250_000

#: Texts encoded at once; the words of all of them are held as strings.
ENCODE_ROWS = 64
#: Bytes of the longest word of each group that is merged at once (a place takes six bits); longer words are merged alone.
MERGE_GROUPS = (12, 24, 48)
#: Texts decoded at once.
DECODE_ROWS = 512

_NO_MERGE, _NO_PAIR = 1 << 60, np.iinfo(np.int32).max
_ODD_SPACE = re.compile("[\x1c-\x1f]")          # white space to Python, not to the pattern
_UNICODE_SPACE = regex.compile(r"\s+", flags=regex.V1)


def _byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(spare)) for b in range(256)]


class Tokenizer:
    """What the definition file says, in the form the tasks use."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != "</w>" or spec["post_processor"] or spec["decoder"]:
            raise ValueError("a word-end BPE definition without post-processor and decoder is expected")
        self.vocab: dict[str, int] = model["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"]]
        #: left id << 20 | right id -> rank << 20 | merged id
        self.merges = {self.vocab[x] << 20 | self.vocab[y]: rank << 20 | self.vocab[x + y] for rank, (x, y) in enumerate(pairs)}
        #: the same as arrays, by left id and right id, for many words at a time
        self.pairs = np.asarray(sorted(self.merges), dtype=np.int64)
        rules = np.asarray([self.merges[p] for p in self.pairs.tolist()], dtype=np.int64)
        self.pair_rank, self.rank_id = (rules >> 20).astype(np.int32), np.zeros(len(pairs), np.int32)
        self.rank_id[self.pair_rank] = rules & 0xFFFFF
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pattern = split
        letters = _byte_letters()
        self.byte_id = [self.vocab[c] for c in letters]
        self.last_byte_id = [self.vocab[c + "</w>"] for c in letters]
        self.token = {i: s for s, i in (self.vocab | self.added).items()}

    def merge(self, word: str) -> list[int]:
        """Ids of one pre-token: the lowest-ranked adjacent pair, leftmost first, until none is left."""
        raw = word.encode("utf-8")
        ids = [self.byte_id[b] for b in raw]
        ids[-1] = self.last_byte_id[raw[-1]]
        if len(ids) > 200:
            return self._merge_long(ids)
        get = self.merges.get
        todo = [get(x << 20 | y, _NO_MERGE) for x, y in zip(ids, ids[1:])]
        while todo:
            best = min(todo)
            if best == _NO_MERGE:
                break
            i = todo.index(best)
            ids[i:i + 2] = [best & 0xFFFFF]
            del todo[i]
            if i:
                todo[i - 1] = get(ids[i - 1] << 20 | ids[i], _NO_MERGE)
            if i < len(todo):
                todo[i] = get(ids[i] << 20 | ids[i + 1], _NO_MERGE)
        return ids

    def merge_all(self, words: list[str]) -> list[bytes]:
        """Ids of every word, as ``merge`` finds them, as little-endian 32-bit integers."""
        raw = [w.encode("utf-8") for w in words]
        size = np.asarray([len(r) for r in raw], dtype=np.int64)
        out: list[bytes] = [b""] * len(words)
        least = 0
        for most in MERGE_GROUPS:
            group = np.flatnonzero((size > least) & (size <= most))
            if len(group):
                for i, ids in zip(group.tolist(), self._merge_group([raw[i] for i in group.tolist()], size[group])):
                    out[i] = ids
            least = most
        for i in np.flatnonzero(size > least).tolist():
            out[i] = np.asarray(self.merge(words[i]), dtype="<i4").tobytes()
        return out

    def _ranks(self, left: np.ndarray, right: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Rank of every pair with its place in the low bits; ``_NO_PAIR`` where there is no merge (an id of -1 has none)."""
        want = left.astype(np.int64) << 20 | right
        at = np.minimum(np.searchsorted(self.pairs, want), len(self.pairs) - 1)
        return np.where(self.pairs[at] == want, self.pair_rank[at] << 6 | place, _NO_PAIR)

    def _merge_group(self, raw: list[bytes], size: np.ndarray) -> list[bytes]:
        """Each round merges the best pair of every word that has one. Row p of the
        arrays is place p of all words; merged symbols leave -1 and are skipped by links."""
        n, places = len(raw), int(size.max())
        word = np.repeat(np.arange(n), size)
        place = np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size)
        letters = np.frombuffer(b"".join(raw), dtype=np.uint8)
        ids = np.full((places + 1, n), -1, np.int32)
        ids[place, word] = np.asarray(self.byte_id, np.int32)[letters]
        last = np.cumsum(size) - 1
        ids[size - 1, np.arange(n)] = np.asarray(self.last_byte_id, np.int32)[letters[last]]
        rank = np.full((places, n), _NO_PAIR, np.int32)
        inner = np.ones(len(word), bool)
        inner[last] = False
        p, w = place[inner], word[inner]
        if len(p) and len(self.pairs):
            rank[p, w] = self._ranks(ids[p, w], ids[p + 1, w], p)
        # links to the next and the previous symbol; row ``places`` stands for none
        after = np.repeat(np.arange(1, places + 2)[:, None], n, axis=1)
        before = np.repeat(np.arange(-1, places)[:, None], n, axis=1)
        live = np.arange(n)
        while True:
            best = rank[:, live].min(axis=0) if len(live) < n else rank.min(axis=0)
            found = best != _NO_PAIR
            live, best = live[found], best[found]
            if not len(live):
                break
            i = best & 63
            j = after[i, live]
            k = after[j, live]
            ids[i, live] = self.rank_id[best >> 6]
            ids[j, live] = -1
            rank[j, live] = _NO_PAIR
            k = np.minimum(k, places)
            after[i, live] = k
            before[k, live] = i
            rank[i, live] = self._ranks(ids[i, live], ids[k, live], i)
            h = before[i, live]
            some = h >= 0
            h, w = h[some], live[some]
            rank[h, w] = self._ranks(ids[h, w], ids[i[some], w], h)
        by_word = ids[:places].T
        kept = by_word >= 0
        codes = by_word[kept].astype("<i4").tobytes()
        ends = (4 * np.cumsum(kept.sum(axis=1))).tolist()
        return [codes[a:b] for a, b in zip([0, *ends], ends)]

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same by a heap over a linked list, for words of thousands of letters."""
        n, merges = len(ids), self.merges
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(merges[p] >> 20, i, p) for i, p in enumerate(x << 20 | y for x, y in zip(ids, ids[1:])) if p in merges]
        heapq.heapify(heap)
        gone = bytearray(n)
        while heap:
            _, i, p = heapq.heappop(heap)
            j = n if gone[i] else after[i]
            if j >= n or ids[i] << 20 | ids[j] != p:
                continue
            ids[i], gone[j] = merges[p] & 0xFFFFF, 1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for left in (before[i], i):
                if left >= 0 and after[left] < n:
                    q = ids[left] << 20 | ids[after[left]]
                    if q in merges:
                        heapq.heappush(heap, (merges[q] >> 20, left, q))
        return [x for x, out in zip(ids, gone) if not out]


class Lexicon:
    """Minimal acyclic automaton over the words' characters (Daciuk et al.
    2000). Equal suffixes share states; every state knows how many words lie
    below each of its arcs, so a walk adds up the word's number, and the number
    leads to its ids. All parts are flat arrays in one byte string; an arc is
    found by binary search for (state, character), many words at a time."""

    _PARTS = ("arc", "target", "skip", "final", "begin", "ids")

    @classmethod
    def compile(cls, words: dict[str, list[int]]) -> bytes:
        """Byte image of the automaton for ``words`` (word -> ids)."""
        order = sorted(words)
        register: dict[tuple, int] = {}
        states: list[tuple[bool, tuple]] = []      # finished: (final, ((char, state), ...))

        def finish(node: list) -> int:
            key = (node[0], tuple(node[1]))
            if key not in register:
                register[key] = len(states)
                states.append(key)
            return register[key]

        # path[i]: open state after i characters of the previous word: [final, arcs]
        path: list[list] = [[False, []]]
        last = ""
        for w in order:
            common = 0
            while common < min(len(w), len(last)) and w[common] == last[common]:
                common += 1
            for i in range(len(last), common, -1):
                state = finish(path.pop())
                path[-1][1].append((last[i - 1], state))
            path += [[False, []] for _ in w[common:]]
            path[-1][0] = True
            last = w
        for i in range(len(last), 0, -1):
            state = finish(path.pop())
            path[-1][1].append((last[i - 1], state))
        root = finish(path[0])
        below = [0] * len(states)                   # states are finished children first
        arc, target, skip = [], [], []
        for s, (final, arcs) in enumerate(states):
            count = int(final)
            for ch, t in arcs:
                arc.append(s << 21 | ord(ch))
                target.append(t)
                skip.append(count)
                count += below[t]
            below[s] = count
        begin = np.cumsum([0] + [len(words[w]) for w in order])
        ids = [i for w in order for i in words[w]]
        parts = [np.asarray(x, dtype="<i8") for x in (arc, target, skip, [f for f, _ in states], begin, ids)]
        head = np.asarray([root, *map(len, parts)], dtype="<i8")
        return head.tobytes() + b"".join(p.tobytes() for p in parts)

    def __init__(self, image: bytes):
        """Writes the image to an unnamed local file and maps it."""
        with tempfile.TemporaryFile() as f:
            f.write(image)
            f.flush()
            self._map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        head = np.frombuffer(self._map, dtype="<i8", count=1 + len(self._PARTS))
        self.root, at = int(head[0]), head.nbytes
        for name, n in zip(self._PARTS, head[1:].tolist()):
            setattr(self, name, np.frombuffer(self._map, dtype="<i8", count=n, offset=at))
            at += 8 * n
        self.codes = self.ids.astype("<i4").tobytes()

    def find(self, words: list[str]) -> list[bytes | None]:
        """Ids of every word as little-endian 32-bit integers, None for words outside the lexicon."""
        size = np.asarray([len(w) for w in words], dtype=np.int64)
        text = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        start = np.cumsum(size) - size
        state, number = np.full(len(words), self.root), np.zeros(len(words), np.int64)
        live = np.flatnonzero(size <= LEXICON_WORD_CHARS) if len(self.arc) else np.zeros(0, np.int64)
        known = np.zeros(len(words), bool)
        depth = 0
        while len(live):
            done = size[live] == depth
            ended = live[done]
            known[ended] = self.final[state[ended]] == 1
            live = live[~done]
            want = state[live] << 21 | text[start[live] + depth]
            at = np.minimum(np.searchsorted(self.arc, want), len(self.arc) - 1)
            hit = self.arc[at] == want
            live, at = live[hit], at[hit]
            number[live] += self.skip[at]
            state[live] = self.target[at]
            depth += 1
        lo, hi = 4 * self.begin[number], 4 * self.begin[np.minimum(number + 1, len(self.begin) - 1)]
        return [self.codes[a:b] if k else None for k, a, b in zip(known.tolist(), lo.tolist(), hi.tolist())]


def normalise(text: str) -> str:
    """NFC, then lower case letter by letter (a capital sigma is always σ)."""
    text = unicodedata.normalize("NFC", text) if not text.isascii() else text
    return text.replace("Σ", "σ").lower()


class Encoder:
    """Encodes texts in one task. White space always ends a pre-token and is
    dropped, so a normalised text is the sequence of its chunks between white
    space, and a chunk's ids can be remembered."""

    def __init__(self, tokenizer: Tokenizer, image: bytes | None):
        self.t = tokenizer
        self.lexicon = Lexicon(image) if image else None
        self.split = regex.compile(tokenizer.pattern, flags=regex.V1)
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(tokenizer.added, key=len, reverse=True))) + ")")
        self.mark = [s[:2] for s in tokenizer.added]
        self.memo: dict[str, bytes] = {}

    def pre_tokens(self, s: str) -> list[str]:
        """Of a normalised chunk."""
        if s.isalpha():                             # nearly all chunks: letters, perhaps with a stop behind them
            return [s]
        if s[-1:] in (".", ",") and s[:-1].isalpha():
            return [s[:-1], s[-1]]
        if s.isascii():
            return self.split.findall(s)
        # code points without a category yet are neither letters nor numbers
        known = "".join(["\u2060" if unicodedata.category(c) == "Cn" else c for c in s])
        return [s[m.start():m.end()] for m in self.split.finditer(known)]

    def chunks(self, text: str) -> list[str]:
        """Normalised chunks; normal forms and small letters do not reach across white space."""
        text = normalise(text)
        return _UNICODE_SPACE.split(text) if _ODD_SPACE.search(text) else text.split()

    def _parts(self, text: str) -> list[str]:
        """The text cut at added tokens, which stay as parts of their own."""
        return self.special.split(text) if any(m in text for m in self.mark) else [text]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of every text as little-endian 32-bit integers."""
        pieces = [[self.chunks(p) if i % 2 == 0 else [p] for i, p in enumerate(self._parts(t))] for t in texts]
        memo = self.memo
        seen = set().union(*(cs for p in pieces for cs in p[::2]))
        new = seen.difference(memo)
        if len(memo) + len(new) > MEMO_CHUNKS:
            memo.clear()
            new = seen
        self._learn(list(new))
        added, known = self.t.added, memo.__getitem__
        out = [b"".join([b"".join(map(known, cs)) if i % 2 == 0 else np.asarray([added[cs[0]]], dtype="<i4").tobytes()
                         for i, cs in enumerate(p)]) for p in pieces]
        for c in new:
            if len(c) > MEMO_CHUNK_CHARS:
                del memo[c]
        return out

    def _learn(self, chunks: list[str]) -> None:
        """Puts the ids of ``chunks`` into the memo."""
        tokens = [self.pre_tokens(c) for c in chunks]
        words = list({w for ws in tokens for w in ws})
        got = self.lexicon.find(words) if self.lexicon else [None] * len(words)
        ids = dict(zip(words, got))
        rare = [w for w, i in ids.items() if i is None]
        ids.update(zip(rare, self.t.merge_all(rare)))
        for c, ws in zip(chunks, tokens):
            self.memo[c] = ids[ws[0]] if len(ws) == 1 else b"".join([ids[w] for w in ws])


def _texts(col: pa.Array) -> Iterator[str]:
    """One Python string at a time, null as empty."""
    return (s.as_py() or "" for s in col)


def frequent_words(df: DataFrame, text: str, tokenizer: Tokenizer, most: int = LEXICON_WORDS) -> list[str]:
    """Commonest pre-tokens of the whole column: all classes of counts (16 a
    doubling) that fit into ``most`` words together. Tasks pass on partial
    counts; only the bounded result reaches the driver."""
    shared = df.sparkSession.sparkContext.broadcast(tokenizer)

    def count(batches):
        enc = Encoder(shared.value, None)
        seen: Counter = Counter()

        def passed_on():
            words: Counter = Counter()
            for chunk, n in seen.items():
                for w in enc.pre_tokens(chunk):
                    if len(w) <= LEXICON_WORD_CHARS:
                        words[w] += n
            seen.clear()
            return pa.RecordBatch.from_pydict({"w": list(words), "n": list(words.values())},
                                              schema=pa.schema([("w", pa.string()), ("n", pa.int64())]))
        for b in batches:
            for s in _texts(b.column(0)):
                seen.update(enc.chunks(s))
                if len(seen) > COUNT_WORDS:
                    yield passed_on()
        yield passed_on()

    st = Stages(df.sparkSession)
    counts = df.select(text).mapInArrow(count, "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))
    # a word seen once can never repay its place in the lexicon
    counts = st.write(counts.where("n > 1").withColumn("size", F.floor(F.log2("n") * 16).cast("int")), "words")
    room, least = most, None
    for r in counts.groupBy("size").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("size")).collect():   # under 1,024 rows
        if r.n > room:
            break
        room, least = room - r.n, r["size"]
    words = [] if least is None else [r.w for r in counts.where(F.col("size") >= least).select("w").collect()]
    st.close()
    return sorted(words)


def build_lexicon(df: DataFrame, text: str, tokenizer: Tokenizer, most: int = LEXICON_WORDS) -> bytes:
    words = frequent_words(df, text, tokenizer, most)
    return Lexicon.compile({w: tokenizer.merge(w) for w in words}) if words else b""


def encode(df: DataFrame, path: str, text: str = "text", out: str = "ids", binary: bool = False,
           lexicon: bytes | None = None) -> DataFrame:
    """``df`` with ``out``: the ids of ``text`` as array<int>, or with
    ``binary`` as one little-endian unsigned 32-bit string of bytes. Raises
    when ``out`` is already a column."""
    if out.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"column {out!r} exists already; name another output column")
    tok = Tokenizer(path)
    image = build_lexicon(df, text, tok) if lexicon is None else lexicon
    sc = df.sparkSession.sparkContext
    shared = sc.broadcast((tok, image))
    at = df.columns.index(text)

    def run(batches):
        enc = Encoder(*shared.value)
        for b in batches:
            for i in range(0, b.num_rows, ENCODE_ROWS):
                part = b.slice(i, ENCODE_ROWS)
                ids = enc.encode(list(_texts(part.column(at))))
                if binary:
                    col = pa.array(ids, type=pa.binary())
                else:
                    offs = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
                    col = pa.ListArray.from_arrays(pa.array(offs), pa.array(np.frombuffer(b"".join(ids), dtype="<i4")))
                yield pa.RecordBatch.from_arrays([*part.columns, col], names=[*part.schema.names, out])

    kind = T.BinaryType() if binary else T.ArrayType(T.IntegerType(), False)
    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, kind)]))


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with ``out``: the token strings of ``ids`` (array<int> or bytes
    as ``encode`` gives) joined by blanks, as a definition without decoder
    prescribes; unknown ids are left out, null ids give null."""
    if out.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"column {out!r} exists already; name another output column")
    shared = df.sparkSession.sparkContext.broadcast(Tokenizer(path).token)
    at = df.columns.index(ids)

    def run(batches):
        token = shared.value
        n = max(token) + 1
        strings = pa.array([token.get(i, "") for i in range(n)], type=pa.string())
        known = np.zeros(n, bool)
        known[list(token)] = True
        for b in batches:
            for i in range(0, b.num_rows, DECODE_ROWS):
                part = b.slice(i, DECODE_ROWS)
                col = part.column(at)
                if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type):
                    raw = [v or b"" for v in col.to_pylist()]
                    size, seq = [len(v) // 4 for v in raw], np.frombuffer(b"".join(raw), dtype="<i4")
                else:
                    size = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False)
                    seq = pc.fill_null(col.flatten(), -1).to_numpy(zero_copy_only=False)
                ok = (seq >= 0) & (seq < n)
                ok[ok] = known[seq[ok]]
                ends = np.concatenate([[0], np.cumsum(ok)])[np.concatenate([[0], np.cumsum(size)]).astype(np.int64)]
                words = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), strings.take(pa.array(seq[ok])))
                got = pc.if_else(col.is_valid(), pc.binary_join(words, " "), pa.scalar(None, pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns, got], names=[*part.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.StringType())]))


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    coded = encode(docs.select("doc_id", "text"), path, binary=True).select("doc_id", "ids")
    both = decode(coded, path)
    return both.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
