"""Array kernels over Arrow text batches: words, rolling hashes, sliding minima.

Hashes are pairs of polynomials modulo a prime over fixed random codes of the bytes. A range hash is a
difference of prefix sums, so any range of a batch is hashed in constant time. Texts are handled as
their UTF-8 bytes, in blocks of about ``BLOCK_BYTES`` so that memory doesn't depend on the batch size: a block takes
about 100 bytes of memory for each byte of text, and a single text longer than a block is a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 19

_U = np.uint64


def _splitmix(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = (np.arange(1, n + 1, dtype=_U) + _U(seed)) * _U(0x9E3779B97F4A7C15)
        z = (z ^ (z >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> _U(27))) * _U(0x94D049BB133111EB)
        return z ^ (z >> _U(31))


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the entropy of 64-bit values over all their bits."""
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


#: Range hashes are two polynomials modulo this prime, each over a base and codes of its own.
PRIME = (1 << 31) - 1
_P, _31 = _U(PRIME), _U(31)
_LOW = _U(0x7FFFFFFF)
_TILE = 1 << 15
#: Names of the hash families: two families share no base.
BASES = (0, 1)


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME, up to one PRIME too much; in place."""
    x_high = x >> _31
    x &= _LOW
    x += x_high
    return x


def _residue(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME; in place."""
    x = _reduced(_reduced(_reduced(x)))
    x[x == _P] = 0
    return x


class Rolling:
    """Range hashes of a sequence of 64-bit codes: 62 bits from two polynomials modulo 2**31 - 1, whose bases are fixed random numbers.

    Different sequences of n codes have the same hash with a chance of about (n / 2**31)**2 over the bases, whatever their
    structure (modulo 2**64 the Thue-Morse word and its complement would have the same for any base).
    """

    _powers: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

    def __init__(self, codes: np.ndarray, family: int) -> None:
        n = len(codes)
        self.lanes = self._grown(family, n + 1)
        self.sums = []
        for lane, (power, _) in enumerate(self.lanes):
            sums = np.empty(n + 1, dtype=_U)
            sums[0] = 0
            terms = sums[1:]
            for at in range(0, n, _TILE):
                part = codes[at : at + _TILE]
                part = (part >> _U(33) if lane else part & _LOW) + _U(1)
                part *= power[at : at + len(part)]
                terms[at : at + len(part)] = _reduced(part)
            np.cumsum(terms, out=terms)
            self.sums.append(sums)

    @classmethod
    def _grown(cls, family: int, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Powers of both bases and of their inverses."""
        have = cls._powers.get(family)
        if have is None or len(have[0][0]) < n:
            size = -(-n // (1 << 16)) << 16
            have = []
            for lane in range(2):
                base = int(_splitmix(1, 1000 * family + lane + 1)[0]) % (PRIME - 2**20) + 2**19
                have.append((cls._all_powers(base, size), cls._all_powers(pow(base, -1, PRIME), size)))
            cls._powers[family] = have
        return have

    @staticmethod
    def _all_powers(base: int, size: int) -> np.ndarray:
        out = np.ones(size, dtype=np.uint32)
        done = 1
        while done < size:
            most = min(done, size - done)
            out[done : done + most] = _residue(out[:most] * _U(pow(base, done, PRIME)))
            done *= 2
        return out

    def grams(self, k: int) -> np.ndarray:
        """Hashes of all runs of k codes."""
        n = max(len(self.sums[0]) - k, 0)
        out = np.empty(n, dtype=_U)
        for at in range(0, n, _TILE):
            end = min(at + _TILE, n)
            out[at:end] = self._hashed([(s[at + k : end + k] - s[at:end], inverse[at:end]) for s, (_, inverse) in zip(self.sums, self.lanes, strict=True)])
        return out

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the runs [start, end); equal for equal codes, and their length counts."""
        out = np.empty(len(start), dtype=_U)
        for at in range(0, len(start), _TILE):
            a, b = start[at : at + _TILE], end[at : at + _TILE]
            length = (b - a).astype(_U) * _U(0xA24BAED4963EE407)
            out[at : at + len(a)] = self._hashed([(s[b] - s[a], inverse[a]) for s, (_, inverse) in zip(self.sums, self.lanes, strict=True)], length)
        return out

    @staticmethod
    def _hashed(lanes: list[tuple[np.ndarray, np.ndarray]], length: np.ndarray | None = None) -> np.ndarray:
        low, high = (_residue(_reduced(_reduced(x)) * inverse) for x, inverse in lanes)
        both = (high << _U(32)) | low
        return mix(both if length is None else both + length)


_BYTE_CODES = _splitmix(256, 17)
_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: 1: ASCII letter, 2: ASCII sign other than an apostrophe, 0: else.
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[[*range(33, 39), *range(40, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 2
#: ASCII capitals to small letters.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_codes(data: np.ndarray) -> np.ndarray:
    return _BYTE_CODES[data]


def seeded(values: np.ndarray, seed: int) -> np.ndarray:
    """Another 64-bit code of each value."""
    return mix(values ^ _U(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))


def as_text(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One large_string array without nulls (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def buffers(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of the array's texts, and where each begins in them (one more entry for the end)."""
    n = len(text)
    if n == 0:
        return np.empty(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, off, dat = text.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[text.offset : text.offset + n + 1]
    data = np.frombuffer(dat, dtype=np.uint8)[offsets[0] : offsets[-1]] if dat is not None else np.empty(0, dtype=np.uint8)
    return data, offsets - offsets[0]


def blocks(batch: pa.RecordBatch, text: str = "text", most: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """The batch in slices of at most ``most`` bytes of text (one row at least), with the texts as as_text() gives them."""
    whole = as_text(batch.column(batch.schema.get_field_index(text)))
    _, offsets = buffers(whole)
    at = 0
    while at < len(whole):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield batch.slice(at, end - at), whole.slice(at, end - at)
        at = end


def portions(batch: pa.RecordBatch, columns: tuple[int, ...], most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices in which these binary columns hold at most ``most`` bytes (one row at least)."""
    size = np.zeros(batch.num_rows, dtype=np.int64)
    for i in columns:
        size += pc.fill_null(pc.binary_length(batch.column(i)), 0).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(size)])
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, ends[at] + most, side="right")) - 1)
        yield batch.slice(at, end - at)
        at = end


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a block of texts.

    data, offsets: the texts' bytes and where each text begins. start, end: each word's bytes.
    first: index of each text's first word (one more entry for the end).
    """

    def __init__(self, text: pa.Array, lower: bool = False, parts: bool = False) -> None:
        """parts: words are cut between ASCII letters and ASCII signs, and ASCII capitals made small unless a mark may follow them."""
        self.data, self.offsets = buffers(text)
        if lower:
            self.data = LOWER[self.data]
        if parts:
            plain = np.append(self.data[1:] < 0x80, True)
            self.data = np.where(plain, LOWER[self.data], self.data)
        n = len(self.data)
        inside = ~_SEPARATOR[self.data]
        self.inside = inside
        edge = np.zeros(n + 1, dtype=bool)
        edge[self.offsets] = True
        if parts and n:
            kind = _KIND[self.data]
            edge[1:n] |= kind[1:] * kind[:-1] == 2
        before = np.empty(n + 1, dtype=bool)
        before[0] = False
        before[1:] = inside
        after = np.empty(n + 1, dtype=bool)
        after[n] = False
        after[:n] = inside
        self.start = np.flatnonzero(after & (~before | edge))
        self.end = np.flatnonzero(before & (~after | edge))
        self.first = np.searchsorted(self.start, self.offsets)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        return Rolling(byte_codes(self.data), BASES[0]).ranges(self.start, self.end)


def sums_by(offsets: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sum of values over each [offsets[i], offsets[i + 1])."""
    total = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def covered(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of n places lie in some [start, end)."""
    step = np.zeros(n + 1, dtype=np.int64)
    np.add.at(step, start, 1)
    np.add.at(step, end, -1)
    return np.cumsum(step[:-1]) > 0


def last_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values, the place of its smallest one, the last of equals.

    Order is by the upper 40 bits and then the place, which is a function of the window alone.
    """
    out = []
    n = len(values) - width + 1
    step = 1 << 23
    for at in range(0, max(n, 0), step):
        m = min(step, n - at)
        part = values[at : at + m + width - 1]
        size = len(part)
        key = (part & _U(0xFFFFFFFFFF000000)) | (_U(0xFFFFFF) - np.arange(size, dtype=_U))
        full = -(-size // width) * width
        padded = np.full(full, 0xFFFFFFFFFFFFFFFF, dtype=_U)
        padded[:size] = key
        grid = padded.reshape(-1, width)
        ahead = np.minimum.accumulate(grid, axis=1).ravel()
        back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        low = np.minimum(back[:m], ahead[width - 1 : width - 1 + m])
        out.append((_U(0xFFFFFF) - (low & _U(0xFFFFFF))).astype(np.int64) + at)
    return np.concatenate(out) if out else np.empty(0, dtype=np.int64)


def grouped_order(values: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """The order by group (below n) and then value."""
    order = np.argsort(values)
    return order[np.argsort(group[order].astype(np.uint16 if n <= 1 << 16 else np.int64), kind="stable")]


def signed(values: np.ndarray) -> np.ndarray:
    """64-bit hashes as Spark's long."""
    return values.view(np.int64)
