"""Token ids of many texts at once: the public byte-level BPE, word by word.

The tokenizer never merges across a single space between two words, so a text is cut before
each space and equal pieces of a batch are encoded once. Texts where that rule might not
hold (runs of white space, characters beyond Latin, special-token strings) go through the
tokenizer whole.
"""

from __future__ import annotations

import numpy as np

from .textscan import chunks

#: Pieces kept from batch to batch in a worker; when full it starts anew.
CACHE = 150_000
#: Bytes of text that are encoded at once.
CHUNK = 1 << 20


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of ``tokenizer``; ``ranks`` is the same vocabulary as ranks, for the pieces."""

    def __init__(self, tokenizer: str | None = None, ranks: str | None = None):
        import base64
        import os

        import public_tokenizers
        import tiktoken

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(tokenizer or tokenizer_file())
        with open(ranks or tokenizer_file("byte_bpe_50k.tiktoken"), "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.piece = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary
        self.bytes_of = np.zeros(max(table.values()) + 1, np.int64)
        for token, i in table.items():
            self.bytes_of[i] = len(token)
        self.known: dict[bytes, bytes] = {}

    def _ids(self, pieces: list[bytes]) -> list[bytes]:
        from array import array

        if len(self.known) > CACHE:
            self.known.clear()
        known = self.known
        new = [p for p in pieces if p not in known]
        # pieces of one space and then no white space at either end stay apart when joined
        plain = [p for p in new if len(p) > 1 and p[0] == 0x20 and p[1] > 0x20 and p[-1] > 0x20 and p[1] < 0xC2]
        ids = np.array(self.piece(b"".join(plain).decode()), np.uint32)
        raw, ends = ids.tobytes(), np.cumsum(self.bytes_of[ids])
        stop = np.cumsum([len(p) for p in plain])
        at = np.searchsorted(ends, stop, "right")
        if len(at) and not np.array_equal(ends[at - 1], stop):
            plain = []
        begin = 0
        for p, e in zip(plain, (4 * at).tolist()):
            known[p] = raw[begin:e]
            begin = e
        for p in new:
            if p not in known:
                known[p] = array("I", self.piece(p.decode())).tobytes()
        return [known[p] for p in pieces]

    def encode(self, column):
        """Yields (first row, end row, ids, off): the ids of those texts in a row (uint32), and
        where each text's ids start. Null counts as empty."""
        import pyarrow as pa

        for lo, hi, data, off in chunks(column, CHUNK):
            n = hi - lo
            space = data == 0x20
            blank = space | ((data >= 0x09) & (data <= 0x0D))
            odd = (data >= 0xC9) | ((data >= 0x1C) & (data <= 0x1F))
            if len(data) > 1:
                odd[1:] |= blank[1:] & blank[:-1] & (space[1:] | space[:-1])
                odd[1:] |= (data[:-1] == 0xC2) & ((data[1:] == 0x85) | (data[1:] == 0xA0))
                odd[1:] |= (data[:-1] == 0x3C) & (data[1:] == 0x7C)
            marks = np.concatenate([[0], np.cumsum(odd, dtype=np.int32)])
            slow = np.flatnonzero(marks[off[1:]] > marks[off[:-1]])
            cut = np.zeros(len(data) + 1, bool)
            cut[:-1] = space
            cut[off] = True
            cut = np.flatnonzero(cut)
            if len(cut) > 1:
                arr = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cut) - 1, [None, pa.py_buffer(cut.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
                coded = arr.dictionary_encode()
                _, ends, raw = coded.dictionary.buffers()
                ends, raw = np.frombuffer(ends, np.int64)[: len(coded.dictionary) + 1].tolist(), raw.to_pybytes()
                found = self._ids([raw[a:b] for a, b in zip(ends, ends[1:])])
                sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
                flat, where = np.frombuffer(b"".join(found), np.uint32), np.concatenate([[0], np.cumsum(sizes)])
                code = coded.indices.to_numpy()
                size = sizes[code]
                begin = np.concatenate([[0], np.cumsum(size)])
                ids = flat[np.repeat(where[code] - begin[:-1], size) + np.arange(begin[-1])]
                at = begin[np.searchsorted(cut, off)]
            else:
                ids, at = np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
            if len(slow):
                parts = [ids[at[i] : at[i + 1]] for i in range(n)]
                for i in slow:
                    parts[i] = np.array(self.whole.encode(data[off[i] : off[i + 1]].tobytes().decode(), add_special_tokens=False).ids, np.uint32)
                ids, at = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            yield lo, hi, ids, at
