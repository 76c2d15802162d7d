"""Best-fit-decreasing packing of token sequences with a segment tree over free room."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 4096
END = 2
# Characters of text whose pieces one packing group receives.
GROUP_CHARS = 16 << 20
# Free room up to this many tokens is left as padding; larger gaps are filled by cutting.
TOLERATED = 8
# Words whose ids a task remembers, and words encoded in one go.
REMEMBERED = 400_000
# Characters of texts whose new words are encoded together.
TOGETHER = 1 << 19
ENCODED_AT_ONCE = 1000
# Pieces handed on at a time.
SENT_AT_ONCE = 1000
MARKS = tuple(".,;:!?")
WORD_END = "</w>"


class WordIds:
    """Token ids of a text through those of its words.

    The vocabulary drops white space and never joins across it, so a text's ids are those of
    its words in a row; words that have been seen are looked up instead of encoded.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.ends = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)
        for token, number in self.tokenizer.get_vocab().items():
            self.ends[number] = token.endswith(WORD_END)

    def __call__(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        return self.of([text])[0]

    def of(self, texts: list[str]) -> list[bytes]:
        """The ids of several texts, whose new words are encoded together.

        Once half of the words to remember are known, they become the older half and the half
        before them is forgotten, but for words that are met again meanwhile.
        """
        split = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        wanted = set().union(*split)
        if len(self.known) > REMEMBERED // 2:
            self.older, self.known = self.known, {}
        missing = self._recalled(wanted)
        if missing:
            self._learn(missing)
        known = self.known
        return [b"".join(map(known.__getitem__, words)) for words in split]

    def _recalled(self, words: set[str]) -> list[str]:
        """The words that neither half knows; those of the older half go over to the newer."""
        known, older = self.known, self.older
        absent = words.difference(known)
        for word in [w for w in absent if w in older]:
            known[word] = older[word]
            absent.remove(word)
        return list(absent)

    def _learn(self, words: list[str]) -> None:
        """Looks up each word's plain form, and encodes the plain forms that are new.

        The vocabulary is lower case and always parts letters and digits from punctuation, so
        "The," has the ids of "the" and of ",".
        """
        known, plain = self.known, {}
        for word in words:
            form = word.lower() if word.isascii() else word
            tail = ""
            if form[-1:] in MARKS and form[-2:-1].isascii() and form[-2:-1].isalnum():
                form, tail = form[:-1], form[-1]
            plain[word] = (form, tail)
        self._encode(sorted(self._recalled({p for pair in plain.values() for p in pair})))
        for word, (form, tail) in plain.items():
            known[word] = known[form] + known[tail]

    def _encode(self, words: list[str]) -> None:
        """Ids of new words, a thousand words in one text.

        A word of letters is one unit of the vocabulary, whose last token is marked as an end;
        anything else is cut by the place of each token in the text.
        """
        letters = [w for w in words if w.isalpha()]
        others = [w for w in words if not w.isalpha()]
        for at in range(0, len(letters), ENCODED_AT_ONCE):
            part = letters[at : at + ENCODED_AT_ONCE]
            found = self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0]
            ids = np.array(found.ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(part):
                self._keep(part, ids, np.append(0, cuts))
            else:
                others += part
        for at in range(0, len(others), ENCODED_AT_ONCE):
            part = others[at : at + ENCODED_AT_ONCE]
            found = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            begins = np.fromiter((o[0] for o in found.offsets), np.int64, len(found.offsets))
            sizes = np.fromiter(map(len, part), np.int64, len(part)) + 1
            cuts = np.searchsorted(begins, np.append(0, np.cumsum(sizes)))
            cuts[-1] = len(begins)
            self._keep(part, np.array(found.ids, "<u4"), cuts)

    def _keep(self, words: list[str], ids: np.ndarray, cuts: np.ndarray) -> None:
        data, bounds = ids.tobytes(), (4 * cuts).tolist()
        self.known.update(zip(words, [data[a:b] for a, b in zip(bounds, bounds[1:])]))


@cache
def word_ids(path: str) -> WordIds:
    """One table of words per worker process, whichever tasks it runs."""
    return WordIds(path)


class RoomTree:
    """Open windows by free room: finds the tightest one that takes a piece.

    The leaves are the possible amounts of room; a node tells whether any leaf below it has an
    open window.
    """

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.filled = np.zeros(2 * self.size, np.int32).tolist()
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, room: int, sequence: int) -> None:
        if room:
            self.open[room].append(sequence)
            self._count(room, 1)

    def _count(self, room: int, step: int) -> None:
        node = self.size + room
        while node:
            self.filled[node] += step
            node >>= 1

    def tightest(self, length: int) -> int | None:
        """The least room of at least `length` that an open window has."""
        node = self.size + length
        if self.filled[node]:
            return length
        while node > 1:
            if not node & 1 and self.filled[node + 1]:
                node += 1
                while node < self.size:
                    node <<= 1
                    if not self.filled[node]:
                        node += 1
                return node - self.size
            node >>= 1
        return None

    def take(self, room: int) -> int:
        self._count(room, -1)
        return self.open[room].pop()


def best_fit(lengths: list[int], window: int) -> list[list[int]]:
    """Windows as lists of piece numbers, for piece lengths in decreasing order."""
    tree, windows = RoomTree(window), []
    for piece, length in enumerate(lengths):
        room = tree.tightest(length)
        if room is None:
            windows.append([piece])
            tree.add(window - length, len(windows) - 1)
        else:
            sequence = tree.take(room)
            windows[sequence].append(piece)
            tree.add(room - length, sequence)
    return windows


Part = tuple[int, int, int]  # piece number, first token within the piece, length


def fill(windows: list[list[int]], lengths: list[int], window: int, tolerated: int) -> list[list[Part]]:
    """Fills what best fit left open.

    The emptiest windows are taken apart and their pieces cut to fill the gaps of the others;
    what is left over at the end becomes sequences of power-of-two lengths, which need no
    padding. Windows with at most `tolerated` free tokens stay as they are.
    """
    used = [sum(lengths[p] for p in w) for w in windows]
    whole = [[(p, 0, lengths[p]) for p in w] for w in windows]

    def fits(n: int) -> bool:
        return n + tolerated >= window or n & (n - 1) == 0

    done = [w for w, n in zip(whole, used) if fits(n)]
    gaps = sorted(((n, i) for i, n in enumerate(used) if not fits(n)), reverse=True)
    first, last = 0, len(gaps) - 1
    loose: list[Part] = []
    while first <= last:
        n, i = gaps[first]
        target, room = whole[i], window - n
        while room > 0 and (loose or first < last):
            if not loose:
                loose = whole[gaps[last][1]][:]
                last -= 1
            piece, start, length = loose.pop()
            cut = min(room, length)
            target.append((piece, start, cut))
            if cut < length:
                loose.append((piece, start + cut, length - cut))
            room -= cut
        first += 1
        if room:
            loose = target
            break
        done.append(target)
    if loose:
        done += _powers(loose)
    return done


def _powers(parts: list[Part]) -> list[list[Part]]:
    total, out = sum(p[2] for p in parts), []
    parts = parts[::-1]
    for bit in reversed(range(total.bit_length())):
        if total >> bit & 1:
            room, target = 1 << bit, []
            while room:
                piece, start, length = parts.pop()
                cut = min(room, length)
                target.append((piece, start, cut))
                if cut < length:
                    parts.append((piece, start + cut, length - cut))
                room -= cut
            out.append(target)
    return out


def pieces(
    docs: DataFrame, tokenizer: str, window: int, end: int, id_column: str, text_column: str
) -> DataFrame:
    """(id, start, doc_tokens, ids): every document's tokens, overlong ones cut into full windows."""

    def run(batches: Iterator[pa.RecordBatch]):
        encode = word_ids(tokenizer)
        last = np.array([end], "<u4").tobytes()
        out: list[tuple] = []
        for batch in batches:
            for key, tokens in zip(batch.column(0).to_pylist(), encoded(encode, batch.column(1))):
                ids = tokens + last
                total = len(ids) // 4
                for at in range(0, total, window):
                    out.append((key, at, total, ids[4 * at : 4 * (at + window)]))
                    if len(out) == SENT_AT_ONCE:
                        yield piece_batch(out)
                        out = []
        if out:
            yield piece_batch(out)

    def encoded(encode: WordIds, column: pa.Array) -> Iterator[bytes]:
        held, size = [], 0
        for text in column:
            held.append(text.as_py() or "")
            size += len(held[-1])
            if size > TOGETHER:
                yield from encode.of(held)
                held, size = [], 0
        yield from encode.of(held)

    def piece_batch(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        columns = [pa.array(c, k) for c, k in zip(zip(*out), kinds)]
        return pa.record_batch(columns, ["id", "start", "doc_tokens", "ids"])

    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(run, "id long, start long, doc_tokens long, ids binary")


def pack(
    docs: DataFrame,
    tokenizer: str,
    window: int = WINDOW,
    end: int = END,
    tolerated: int = TOLERATED,
    group_chars: int = GROUP_CHARS,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """(id, start, length, doc_tokens, sequence_id, offset, ids): one row per piece.

    A document is the ids of its text and then `end`; null text is empty. Pieces are dealt by
    hash to groups of about `group_chars` characters of text, as many as the input needs, and
    each group is packed on its own: best fit in decreasing order, then `fill`. `ids` holds the
    piece's tokens as little-endian unsigned 32-bit numbers. Repeated rows and null ids are
    packed like any others. The result depends on the rows alone, so a lost task is redone
    with the same outcome.
    """
    chars = docs.agg(F.sum(F.length(text_column)), F.count("*")).first()
    groups = -(-((chars[0] or 0) + chars[1]) // group_chars) or 1
    dealt = pieces(docs, tokenizer, window, end, id_column, text_column).withColumn(
        "bin", F.pmod(F.xxhash64("id", "start", "ids"), F.lit(groups))
    )
    order = [F.col("bin"), F.length("ids").desc(), F.col("id"), F.col("start")]
    sent = dealt.repartition("bin").sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]):
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0][4] != row[4]:
                    yield from packed(held)
                    held = []
                held.append(row)
        if held:
            yield from packed(held)

    def packed(rows: list[tuple]):
        lengths = [len(r[3]) // 4 for r in rows]
        windows = fill(best_fit(lengths, window), lengths, window, tolerated)
        out = []
        for number, parts in enumerate(windows):
            offset = 0
            for piece, start, length in parts:
                key, first, total, ids, group = rows[piece]
                own = ids[4 * start : 4 * (start + length)]
                out.append((key, first + start, length, total, group << 32 | number, offset, own))
                offset += length
        columns = list(zip(*out))
        names = ["id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
        for at in range(0, len(out), SENT_AT_ONCE):
            arrays = [pa.array(c[at : at + SENT_AT_ONCE], pa.int64()) for c in columns[:-1]]
            arrays.append(pa.array(columns[-1][at : at + SENT_AT_ONCE], pa.binary()))
            yield pa.record_batch(arrays, names)

    schema = "id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    return sent.mapInArrow(run, schema)

