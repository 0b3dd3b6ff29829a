"""Vector bin packing of examples into training sequences.

Each example is a vector (tokens, one segment, loss-bearing tokens); a sequence
limits all three. A sequence is filled from a pool: of the examples that still
fit, the one whose vector has the largest dot product with the remaining
capacity goes in next, both measured in parts of the limits. When nothing fits,
the head of a longer example fills the gap, unless the gap is shorter than
``min_piece``. Examples beyond a limit give up whole sequences first.

Every partition packs its own rows, so nothing is shuffled and no group of rows
has to meet in a task; the sequence that a partition leaves unfilled at its end
is dealt out as sequences of power-of-two lengths, which need no padding.
"""

import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import functions as F

from ledgerlark.llm.common import arrow_schema, batch_of_rows, lists
from ledgerlark.llm.tokens import encoder, end_bytes

#: Examples that a task chooses from.
POOL = 2048

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
PLACES = "example_id long, start long, length long, sequence_id long, offset long"


class Packer:
    """add(key, tokens, loss) and finish() yield (key, start, length, sequence, offset).
    The last ``loss`` tokens of an example bear loss, as a response follows its prompt."""

    def __init__(self, max_tokens, max_segments, max_loss, min_piece=8, pool=POOL):
        if min(max_tokens, max_segments, max_loss) < 1:
            raise ValueError("limits must be positive")
        self.limits = np.array([max_tokens, max_segments, max_loss], dtype=float)
        self.max_tokens, self.max_segments, self.max_loss = max_tokens, max_segments, max_loss
        self.min_piece = max(1, min_piece)
        self.size = np.zeros((pool, 2), dtype=np.int64)  # tokens and loss left; a free place has 0 tokens
        self.items = [None] * pool  # key, tokens already placed
        self.free = list(range(pool - 1, -1, -1))
        self.sequence = 0

    def add(self, key, tokens, loss):
        if tokens < 1:
            return
        start = 0
        while tokens > self.max_tokens or loss > self.max_loss:
            head = self._head(tokens, loss, self.max_tokens, self.max_loss)
            yield key, start, head, self.sequence, 0
            self.sequence += 1
            start, tokens, loss = start + head, tokens - head, min(loss, tokens - head)
            if not tokens:
                return
        place = self.free.pop()
        self.size[place], self.items[place] = (tokens, loss), (key, start)
        while not self.free:
            yield from self._emit(self._fill())

    @staticmethod
    def _head(tokens, loss, room, loss_room):
        """The longest head that fits: its loss is what it has of the tail of ``loss`` tokens."""
        return min(tokens, room, tokens - loss + loss_room)

    def _take(self, place, length):
        key, start = self.items[place]
        tokens, loss = (int(x) for x in self.size[place])
        self.size[place], self.items[place] = (tokens - length, min(loss, tokens - length)), (key, start + length)
        if tokens == length:
            self.items[place] = None
            self.free.append(place)
        return (key, start, length), loss - min(loss, tokens - length)

    def _fill(self):
        """The pieces of one sequence."""
        room, segments, loss_room, pieces = self.max_tokens, self.max_segments, self.max_loss, []
        tokens, loss = self.size[:, 0], self.size[:, 1]
        while room and segments:
            fits = (tokens > 0) & (tokens <= room) & (loss <= loss_room)
            if fits.any():
                gain = np.where(fits, tokens * (room / self.limits[0] ** 2) + segments / self.limits[1] ** 2 + loss * (loss_room / self.limits[2] ** 2), -1.0)
                place = int(gain.argmax())
                piece, spent = self._take(place, int(tokens[place]))
            else:
                place = int(tokens.argmax())
                length = self._head(int(tokens[place]), int(loss[place]), room, loss_room) if tokens[place] else 0
                if length < self.min_piece:
                    break
                piece, spent = self._take(place, length)
            pieces.append(piece)
            room, segments, loss_room = room - piece[2], segments - 1, loss_room - spent
        return pieces

    def _emit(self, pieces):
        offset = 0
        for key, start, length in pieces:
            yield key, start, length, self.sequence, offset
            offset += length
        self.sequence += 1

    def finish(self):
        while len(self.free) < len(self.items):
            pieces = self._fill()
            if len(self.free) < len(self.items) or sum(piece[2] for piece in pieces) == self.max_tokens:
                yield from self._emit(pieces)
            else:
                yield from self._in_powers(pieces)

    def _in_powers(self, pieces):
        left = sum(piece[2] for piece in pieces)
        pieces = pieces[::-1]
        while left:
            want = 1 << left.bit_length() - 1
            left -= want
            own = []
            while want:
                key, start, length = pieces.pop()
                if length > want:
                    pieces.append((key, start + want, length - want))
                    length = want
                own.append((key, start, length))
                want -= length
            yield from self._emit(own)


def _sequence_base():
    return TaskContext.get().partitionId() << 40


def pack_examples(examples, max_tokens=2048, max_segments=512, max_loss=2048, min_piece=8):
    """Place ``examples`` (example_id, n_tokens, n_loss) into sequences: example_id,
    start, length, sequence_id, offset. Null or negative counts are 0, the loss is at
    most the tokens, and an example without tokens has no piece; null and repeated
    ids are kept; other columns are not read."""
    tokens = F.greatest(F.coalesce(F.col("n_tokens").cast("long"), F.lit(0)), F.lit(0))
    rows = examples.select(
        F.col("example_id").cast("long").alias("example_id"),
        tokens.alias("tokens"),
        F.least(tokens, F.greatest(F.coalesce(F.col("n_loss").cast("long"), F.lit(0)), F.lit(0))).alias("loss"),
    )

    def pack(batches):
        packer, base = Packer(max_tokens, max_segments, max_loss, min_piece), _sequence_base()

        def placed(found):
            return batch_of_rows(arrow_schema(PLACES), [(key, start, length, base + sequence, offset) for key, start, length, sequence, offset in found])

        for records in batches:
            found = []
            for key, tokens, loss in zip(*lists(records, "example_id", "tokens", "loss")):
                found += packer.add(key, tokens, loss)
            yield placed(found)
        yield placed(list(packer.finish()))

    return rows.mapInArrow(pack, PLACES)


def pack_documents(docs, vocabulary, end_id=1, max_tokens=2048, max_segments=512, min_piece=8):
    """Encode ``docs`` (doc_id, text) and place every id, each document's end id
    included, into exactly one piece of a sequence. All tokens bear loss.

    A null text counts as empty, which leaves the end id; null and repeated ids
    are kept as documents of their own; an empty table gives no piece; other
    columns are not read."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def pack(batches):
        encode, end, base = encoder(vocabulary).ids, end_bytes(end_id), _sequence_base()
        packer, held, number = Packer(max_tokens, max_segments, max_tokens, min_piece), {}, 0

        def placed(found):
            pieces = []
            for key, start, length, sequence, offset in found:
                doc_id, ids, left = held[key]
                crc = zlib.crc32(memoryview(ids)[4 * start : 4 * (start + length)])
                pieces.append((doc_id, start, length, crc, len(ids) // 4, base + sequence, offset))
                if left == length:
                    del held[key]
                else:
                    held[key] = doc_id, ids, left - length
            return batch_of_rows(arrow_schema(PIECES), pieces)

        for records in batches:
            found = []
            for doc_id, text in zip(*lists(records, "doc_id", "text")):
                ids = encode(text) + end
                held[number] = (doc_id, ids, len(ids) // 4)
                found += packer.add(number, len(ids) // 4, len(ids) // 4)
                number += 1
            yield placed(found)
        yield placed(list(packer.finish()))

    return rows.mapInArrow(pack, PIECES)
