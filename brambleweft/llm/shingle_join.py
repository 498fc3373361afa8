"""N-gram Jaccard join with signature trees; components of linked texts.

Texts become sets of hashed word shingles. Equal sets are one node. The join
finds every pair of nodes with ``den * |A and B| >= num * |A or B|``:

1. *Keys.* Two such sets of at least s shingles differ in at most
   d = s (den - num) / num of them. Hash ranges, up to six parts each, are so
   many that some range differs in fewer shingles than it has parts, so one of
   its parts is the same in both: texts that share no key for a part are never
   linked. Parts without shingles are no keys (too common); their range is
   dealt anew with another hash, which both texts do alike, so nothing is lost.
   Size classes fix d; texts near a border are also filed in the class below.
2. *Signature trees over ranges.* Within a key, rows carry a 64-bit bitmap of
   their range. Leaves are bitmaps, inner nodes hold the OR of their children
   and the least number of bits. A dual traversal prunes pairs of nodes that
   must differ in more than r bits, and pairs of nodes that are one component
   already. Rows with the same bitmap are linked without comparing. What
   remains are candidate links, a forest of them per task.
3. *Clusters.* Connected components of the candidates hold all links. Their
   sets, and no others, are fetched and brought together, one copy a node; a
   cluster above ``SETS`` sets or ``TOKENS`` shingles is cut into blocks.
4. *Signature trees over sets.* Trees of wide bitmaps with size ranges prune
   by the largest possible overlap and skip node pairs that are already one
   component; surviving pairs are compared exactly. Every cluster and block
   goes through its tree, whatever its size.
5. Connected components of the exact links give each document its class.

All of this is exact but for collisions of 64-bit hashes.

Defined results: null and blank texts have an empty set, no links, and are
their own component; texts with fewer words than a shingle count as one
shingle; equal texts are linked; a null id gives a null component unless it is
linked; repeated rows each get their row; an empty table gives an empty
result. Only the named columns are read, so extra columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import HAS_WORD, checkpoint, text_slices
from .components import components

#: Ratio of the borders of size classes.
RATIO = 1.4
#: The r above, at most; and how often a range with an empty part is dealt anew.
DIFFER, LEVELS = 5, 16
FANOUT = 8
#: Bytes of text, shingles, and rows of key groups that are handled at a time.
SLICE, PIECE, ROWS = 1 << 20, 1 << 18, 1 << 17
#: Pairs of tree nodes that are looked at together.
PAIRS = 1 << 17
#: Shingles and sets that a task of the exact comparison holds per block, about.
TOKENS, SETS = 1 << 19, 512
#: Sets of a large cluster that every block of it is compared with first.
LEADERS = 16
#: Tasks that the members of one cluster are dealt to.
SALTS = 32
#: Nodes that a task remembers in order to file equal sets once.
REMEMBERED = 1 << 18
#: Bits of the filter that spares fetching sets without a candidate link.
FILTER_BITS = 1 << 23

U = np.uint64
_BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_LETTERS = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_LETTERS[ord("A") : ord("Z") + 1] = _LETTERS[ord("a") : ord("z") + 1]
_BASE = 0x9E3779B97F4A7C15
_STEPS = np.arange(64, dtype=U) * U(_BASE)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit changes every output bit."""
    y = x >> U(30)
    y ^= x
    y *= U(0xBF58476D1CE4E5B9)
    y ^= y >> U(27)
    y *= U(0x94D049BB133111EB)
    y ^= y >> U(31)
    return y


def _powers(base: int) -> np.ndarray:
    p = np.full(PIECE + 1, base, U)
    p[0] = 1
    return np.multiply.accumulate(p)


_POWERS, _INVERSES = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


def word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash and the end of every word, letters A-Z in lower case.

    Bytes are read in pieces; a word that a piece leaves open is carried on.
    """
    hashes, places = [], []
    open_hash = open_size = 0
    for at in range(0, len(raw), PIECE):
        piece = raw[at : at + PIECE]
        edge = np.flatnonzero(np.diff(_BLANK[piece], prepend=True, append=True))
        starts, ends = edge[::2], edge[1::2]
        run = np.zeros(len(piece) + 1, U)
        np.cumsum(_LETTERS[piece] * _POWERS[: len(piece)], out=run[1:])
        value, size = (run[ends] - run[starts]) * _INVERSES[starts], ends - starts
        if open_size:
            if len(starts) and starts[0] == 0:
                value[0] = (open_hash + int(value[0]) * pow(_BASE, open_size, 1 << 64)) & (1 << 64) - 1
                size[0] += open_size
            else:
                value, size, ends = np.append(U(open_hash), value), np.append(open_size, size), np.append(0, ends)
        open_size = 0
        if len(ends) and ends[-1] == len(piece) and at + len(piece) < len(raw):
            open_hash, open_size = int(value[-1]), int(size[-1])
            value, size, ends = value[:-1], size[:-1], ends[:-1]
        hashes.append(mix(value + size.astype(U)))
        places.append(ends + at)
    if not hashes:
        return np.zeros(0, U), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(places)


def shingle_sets(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts in a row, and each text's number of them."""
    ends_of = np.cumsum([len(t) + 1 for t in texts])
    words, places = word_hashes(np.frombuffer(b"\n".join(texts) + b"\n", np.uint8))
    # A word ends before the line feed behind its text, at the latest.
    bounds = np.searchsorted(places, ends_of, side="left")
    n = np.diff(bounds, prepend=0)
    first = bounds - n
    rolled = np.zeros(len(words), U)
    for k in range(min(size, len(words))):
        part = rolled[: len(words) - k]
        part *= U(3)
        part += words[k:]
        part[:] = mix(part)
    tokens = []
    for i, (f, m) in enumerate(zip(first.tolist(), n.tolist(), strict=True)):
        if m >= size:
            some = rolled[f : f + m - size + 1]
            some.sort()
            new = np.ones(len(some), bool)
            np.not_equal(some[1:], some[:-1], out=new[1:])
            tokens.append(some if new.all() else some[new])
        else:
            h = np.full(min(m, 1), m, U)  # too short: the whole sequence
            for w in range(f, f + m):
                h = mix(h * U(5) + words[w : w + 1])
            tokens.append(h)
    return np.concatenate(tokens) if tokens else np.zeros(0, U), np.array([len(t) for t in tokens], np.int64)


def node_ids(tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One hash per set, as a signed number; 0 for empty sets."""
    run = np.concatenate((np.zeros(1, U), np.cumsum(mix(tokens ^ U(0x5BD1E995)))))
    ends = np.cumsum(counts)
    nodes = mix(run[ends] - run[ends - counts] + counts.astype(U))
    nodes[counts == 0] = 0
    return nodes.view(np.int64)


class Scheme:
    """Size classes and their numbers of ranges for a threshold num / den."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den = num, den
        borders = [1]
        while borders[-1] < 1 << 40:
            borders.append(max(borders[-1] + 1, int(borders[-1] * RATIO)))
        self.borders = np.array(borders)
        most = (self.borders[1:] - 1) * (den - num) // num
        # Equal sets are one node already, so classes without room to differ need no key.
        self.parts = np.where(most > 0, np.minimum(most, DIFFER) + 1, 0)
        self.ranges = np.where(most > 0, -(-(most + 1) // np.maximum(self.parts, 1)), 0)

    def roles(self, n: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(texts, class): each text's own class, and the one below if a partner may be in it."""
        own = np.searchsorted(self.borders, n, side="right") - 1
        smallest = -(-n * self.num // self.den)
        out, back = [(np.flatnonzero(n > 0), own)], 1
        while True:
            lower = own - back
            some = np.flatnonzero((n > 0) & (lower >= 0) & (smallest < self.borders[np.maximum(lower + 1, 0)]))
            if not len(some):
                return out
            out.append((some, np.maximum(lower, 0)))
            back += 1


def key_rows(scheme: Scheme, tokens: np.ndarray, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(key, text, bitmap) rows of sets laid out as by ``shingle_sets``, in parts of about PIECE shingles."""
    firsts = np.concatenate(([0], np.cumsum(counts)[:-1]))
    for some, classes in scheme.roles(counts):
        some = some[scheme.ranges[classes[some]] > 0]
        for i in some[counts[some] > PIECE].tolist():
            # The ranges of a long text are taken a window at a time.
            own, t = classes[i : i + 1], tokens[firsts[i] : firsts[i] + counts[i]]
            ranges = int(scheme.ranges[own[0]])
            step = max(1, ranges * PIECE // len(t))
            for low in range(0, ranges, step):
                yield _window_rows(scheme, t, np.array([i]), own, np.array([len(t)]), low, min(low + step, ranges))
        short = some[counts[some] <= PIECE]
        ends = np.cumsum(counts[short])
        for part in np.split(short, np.flatnonzero(np.diff(ends // PIECE)) + 1) if len(short) else []:
            n = counts[part]
            at = np.repeat(firsts[part] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            yield _window_rows(scheme, tokens[at], part, classes[part], n)


def _window_rows(scheme: Scheme, t: np.ndarray, some: np.ndarray, own: np.ndarray, n: np.ndarray, low: int = 0, high: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key rows of the sets ``t`` of texts ``some``: of all their ranges, or of those from low to high."""
    keys, texts, maps = [], [], []
    parts, ranges = scheme.parts[own], scheme.ranges[own]
    who = np.repeat(np.arange(len(some)), n)
    h = mix(t + own.astype(U)[who] * U(0xD6E8FEB86659FD93))
    place = ((h >> U(32)) * ranges.astype(U)[who] >> U(32)).astype(np.int64)
    if high is not None:
        inside = np.flatnonzero((place >= low) & (place < high))
        h, who, place, ranges = h[inside], who[inside], place[inside] - low, np.array([high - low])
    base = np.cumsum(ranges) - ranges
    owner = np.repeat(np.arange(len(some)), ranges)
    place += base[who]
    wide = parts[owner]  # parts of every range
    start = np.cumsum(wide) - wide
    range_of = np.repeat(np.arange(len(wide)), wide)
    bitmap = np.zeros(len(wide), U)
    np.bitwise_or.at(bitmap, place, U(1) << (h & U(63)))
    weight, active = mix(h), np.ones(len(wide), bool)
    number = np.arange(len(range_of)) - start[base[owner[range_of]]] + low * wide[range_of]
    salt = number.astype(U) * U(LEVELS) + own.astype(U)[owner[range_of]] * U(0xC2B2AE3D27D4EB4F)
    for level in range(LEVELS):
        part = start[place] + ((mix(h + _STEPS[level + 1]) >> U(32)) * wide[place].astype(U) >> U(32)).astype(np.int64)
        sums, empty = np.zeros(len(range_of), U), np.ones(len(range_of), bool)
        np.add.at(sums, part, weight)
        empty[part] = False
        p = np.flatnonzero(active[range_of] & (~empty if level + 1 < LEVELS else True))
        r = range_of[p]
        # The three low bits of a key tell how many bits may differ.
        keys.append(mix(sums[p] + mix(salt[p] + U(level))) & ~U(7) | (wide[r] - 1).astype(U))
        texts.append(some[owner[r]])
        maps.append(bitmap[r])
        active &= np.logical_or.reduceat(empty, start)
        live = active[place]
        if not active.any():
            break
        place, h, weight = place[live], h[live], weight[live]
    return np.concatenate(keys), np.concatenate(texts), np.concatenate(maps)


class Union:
    """Labels of connected items: the smallest item of each component."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Connect the pairs; what it returns is a forest (rows of two items) that connects the same."""
        links = [np.zeros((0, 2), np.int64)]
        while True:
            x, y = self.label[a], self.label[b]
            live = x != y
            if not live.any():
                return np.concatenate(links)
            a, b, x, y = a[live], b[live], x[live], y[live]
            up = np.arange(len(self.label))
            np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
            joined = np.unique(np.maximum(x, y))
            links.append(np.stack([joined, up[joined]], 1))
            while not np.array_equal(up, over := up[up]):
                up = over
            self.label = up[self.label]


def near_bitmaps(maps: np.ndarray, starts: np.ndarray, most: np.ndarray, who: np.ndarray) -> np.ndarray:
    """A forest that joins items (``who``) with rows of the same group (from ``starts``) whose bitmaps differ in at most ``most`` bits.

    One signature tree per group, all walked together, depth first and at most
    ``PAIRS`` pairs of nodes at a time. Pairs are joined as they are found, and
    two nodes whose rows are one component already are not walked any further,
    so neither memory nor the result grows with the number of pairs.
    """
    size = np.diff(np.append(starts, len(maps)))
    levels = [(maps, np.bitwise_count(maps).astype(np.int64), most, None, None)]
    first = starts
    while len(size) and size.max() > 1:
        up = -(-size // FANOUT)
        up_first = np.cumsum(up) - up
        group = np.repeat(np.arange(len(size)), up)
        within = np.arange(up.sum()) - up_first[group]
        child = first[group] + within * FANOUT
        children = np.minimum(size[group] - within * FANOUT, FANOUT)
        low = levels[-1]
        levels.append((np.bitwise_or.reduceat(low[0], child), np.minimum.reduceat(low[1], child), low[2][child], child, children))
        first, size = up_first, up
    union, links = Union(int(who.max()) + 1 if len(who) else 0), [np.zeros((0, 2), np.int64)]
    one = _components_of(union.label[who], levels)
    roots = np.arange(len(levels[-1][0]))
    stack = [(len(levels) - 1, roots, roots)]
    while stack:
        depth, a, b = stack.pop()
        if not depth:
            new = union.join(who[a], who[b])
            if len(new):
                links.append(new)
                one = _components_of(union.label[who], levels)
            continue
        live = (one[depth][a] != one[depth][b]) | (one[depth][a] < 0)
        x, y = _children(*levels[depth][3:], a[live], b[live], stack, depth)
        if x is None:
            continue
        m, bits, limit = levels[depth - 1][:3]
        differ = bits[x] + bits[y] - 2 * np.bitwise_count(m[x] & m[y]).astype(np.int64)
        good = (differ <= limit[x]) & ((x < y) if depth == 1 else (x <= y)) & ((one[depth - 1][x] != one[depth - 1][y]) | (one[depth - 1][x] < 0))
        stack.append((depth - 1, x[good], y[good]))
    return np.concatenate(links)


def _components_of(label: np.ndarray, levels: list[tuple]) -> list[np.ndarray]:
    """Per level, the component that all leaves of a node belong to, or -1."""
    out = [label]
    for level in levels[1:]:
        low, high = np.minimum.reduceat(out[-1], level[-2]), np.maximum.reduceat(out[-1], level[-2])
        out.append(np.where(low == high, low, -1))
    return out


def _children(child: np.ndarray, children: np.ndarray, a: np.ndarray, b: np.ndarray, stack: list, depth: int, most: int = PAIRS) -> tuple:
    """All pairs of children of node pairs; too many at once go back to the stack in halves."""
    wide = children[a] * children[b]
    if len(a) > 1 and int(wide.sum()) > most:
        half = len(a) // 2
        stack += [(depth, a[:half], b[:half]), (depth, a[half:], b[half:])]
        return None, None
    pair = np.repeat(np.arange(len(a)), wide)
    k = np.arange(wide.sum()) - np.repeat(np.cumsum(wide) - wide, wide)
    return child[a][pair] + k // children[b][pair], child[b][pair] + k % children[b][pair]


class Forest:
    """Union by a table of parents, of bounded size; tells which links joined two trees."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = x
        while (p := self.parent.setdefault(root, root)) != root:
            root = p
        while (p := self.parent[x]) != root:
            self.parent[x] = root
            x = p
        return root

    def join(self, a: int, b: int) -> bool:
        if len(self.parent) > REMEMBERED:  # forgotten links are only given once more
            self.parent.clear()
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)
        return a != b


def _distinct_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    pairs = np.stack([a, b], 1)[a != b]
    pairs.sort(axis=1)
    return np.unique(pairs, axis=0)


def _fold(key: np.ndarray, maps: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the first row of each key and bitmap, and links of the other rows to these."""
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (maps[1:] != maps[:-1])
    heads = np.flatnonzero(new)
    return heads, _distinct_pairs(node[heads[np.cumsum(new) - 1]], node)


def _candidates(key: np.ndarray, maps: np.ndarray, node: np.ndarray) -> np.ndarray:
    """A forest of candidate links (rows of two nodes) of rows sorted by key, with distinct bitmaps."""
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    size = np.diff(np.append(np.flatnonzero(new), len(key)))
    rows = np.flatnonzero(np.repeat(size > 1, size))
    size = size[size > 1]
    names, who = np.unique(node[rows], return_inverse=True)
    return names[near_bitmaps(maps[rows].view(U), np.cumsum(size) - size, key[rows] & 7, who)]


def candidate_links(rows: DataFrame) -> DataFrame:
    """(u, v) forests of candidate links from (key, node, bitmap) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        held: list[list[np.ndarray]] = []

        def kept(pairs: np.ndarray) -> pa.RecordBatch:
            links = [(a, b) for a, b in pairs.tolist() if forest.join(a, b)]
            return pa.record_batch([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["u", "v"])

        for batch in batches:
            rows = [np.asarray(batch.column(c)) for c in ("key", "bitmap", "node")]
            if held:  # the last row may have the same key and bitmap as the first ones here
                rows = [np.concatenate([h[-1:], r]) for h, r in zip(held[-1], rows, strict=True)]
            heads, same = _fold(*rows)
            yield kept(same)
            rows = [r[heads] for r in rows]
            if held:
                rows = [r[1:] for r in rows]
                if sum(len(h[0]) for h in held) >= ROWS and len(rows[0]) and rows[0][-1] != held[-1][0][-1]:
                    cut = np.searchsorted(rows[0], held[-1][0][-1], side="right")
                    held.append([r[:cut] for r in rows])
                    yield kept(_candidates(*[np.concatenate(p) for p in zip(*held, strict=True)]))
                    held, rows = [], [r[cut:] for r in rows]
            if len(rows[0]):
                held.append(rows)
        if held:
            yield kept(_candidates(*[np.concatenate(p) for p in zip(*held, strict=True)]))

    sorted_rows = rows.repartition("key").sortWithinPartitions("key", "bitmap", "node")
    return sorted_rows.mapInArrow(run, "u long, v long")


def _wide_maps(sets: list[np.ndarray], words: int) -> np.ndarray:
    maps = np.zeros((len(sets), words), U)
    for i, s in enumerate(sets):
        bit = (s >> U(20)) % U(words * 64)
        np.bitwise_or.at(maps[i], (bit >> U(6)).astype(np.int64), U(1) << (bit & U(63)))
    return maps


def linked_sets(sets: list[np.ndarray], num: int, den: int, known: list[int] | None = None) -> list[tuple[int, int]]:
    """A forest of the exact links between sets.

    Sets are leaves of one signature tree, which is walked against itself. Sets
    of like size are compared first, only to put those that are linked side by
    side: whole nodes of one component are skipped. ``known`` gives components
    that are linked already.
    """
    n = np.array([len(s) for s in sets])
    links: list[tuple[int, int]] = []
    label = np.unique(known, return_inverse=True)[1] if known is not None else np.arange(len(sets))

    def compare(i: int, j: int) -> bool:
        if label[i] == label[j] or min(n[i], n[j]) * den < max(n[i], n[j]) * num:
            return False
        shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        if den * shared < num * (n[i] + n[j] - shared):
            return False
        label[label == max(label[i], label[j])] = min(label[i], label[j])
        links.append((i, j))
        return True

    order = np.argsort(n, kind="stable").tolist()
    for a, b in zip(order[:-1], order[1:], strict=True):
        compare(a, b)
    order = np.lexsort((n, label))
    maps = _wide_maps(sets, min(64, max(4, -(-int(n.max()) * 2 // 64))))
    size = n[order]
    levels = [(maps[order], size, size, size - np.bitwise_count(maps).sum(1).astype(np.int64)[order], None, None)]
    while len(levels[-1][0]) > 1:
        lm, lo, hi, spare, _, _ = levels[-1]
        at = np.arange(0, len(lm), FANOUT)
        levels.append((np.bitwise_or.reduceat(lm, at, axis=0), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(spare, at), at, np.minimum(len(lm) - at, FANOUT)))
    one = _components_of(label[order], levels)
    root = np.zeros(1, np.int64)
    stack = [(len(levels) - 1, root, root)]
    while stack:
        depth, a, b = stack.pop()
        if not depth:
            # Few at a time, since every link spares others.
            i, j, more = order[a[:256]], order[b[:256]], order[a[256:]]
            if len(more):
                stack.append((0, a[256:], b[256:]))
            live = label[i] != label[j]
            if any([compare(x, y) for x, y in zip(i[live].tolist(), j[live].tolist(), strict=True)]):
                one = _components_of(label[order], levels)
            continue
        x, y = _children(*levels[depth][4:], a, b, stack, depth, 1 << 15)
        if x is None:
            continue
        lm, lo, hi, spare = levels[depth - 1][:4]
        good = ((one[depth - 1][x] != one[depth - 1][y]) | (one[depth - 1][x] < 0)) & ((x < y) if depth == 1 else (x <= y)) & (hi[x] * den >= lo[y] * num) & (hi[y] * den >= lo[x] * num)
        x, y = x[good], y[good]
        shared = np.minimum(np.bitwise_count(lm[x] & lm[y]).sum(1, dtype=np.int64) + np.minimum(spare[x], spare[y]), np.minimum(hi[x], hi[y]))
        # The largest possible overlap must reach what the smallest sizes need.
        good = (shared * (num + den) >= num * (lo[x] + lo[y])) | ((x == y) & (depth > 1))
        stack.append((depth - 1, x[good], y[good]))
    return links


def document_nodes(docs: DataFrame, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, node) of every row."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, texts in text_slices(batch.column("text"), SLICE):
                tokens, counts = shingle_sets(texts, size)
                yield pa.record_batch([batch.column("doc_id")[s], pa.array(counts, pa.int64()), pa.array(node_ids(tokens, counts))], names=["doc_id", "n_shingles", "node"])

    return slim.mapInArrow(run, "doc_id long, n_shingles long, node long")


def _keyed(docs: DataFrame, size: int, scheme: Scheme, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, texts in text_slices(batch.column("text"), SLICE):
                tokens, counts = shingle_sets(texts, size)
                nodes = node_ids(tokens, counts)
                fresh = np.zeros(len(nodes), bool)
                for i, x in enumerate(nodes.tolist()):
                    if x not in seen:
                        seen.add(x)
                        fresh[i] = True
                if len(seen) > REMEMBERED:
                    seen.clear()
                if not fresh.all():
                    tokens, counts = tokens[np.repeat(fresh, counts)], np.where(fresh, counts, 0)
                for key, text, bitmap in key_rows(scheme, tokens, counts):
                    yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(nodes[text]), pa.array(bitmap.view(np.int64))], names=["key", "node", "bitmap"])

    return docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("text <> ''").mapInArrow(run, "key long, node long, bitmap long")


def _sets(docs: DataFrame, size: int, wanted: DataFrame, text_col: str) -> DataFrame:
    """(node, tokens) of the nodes in ``wanted``, and of few others.

    A bitmap of fixed size (FILTER_BITS) of the wanted nodes goes to all tasks.
    """
    spot = F.pmod(F.col("node"), F.lit(FILTER_BITS))
    cells = wanted.select(F.floor(spot / 32).cast("int").alias("cell"), F.call_function("shiftleft", F.lit(1).cast("long"), (spot % 32).cast("int")).alias("bit")).groupBy("cell").agg(F.bit_or("bit").alias("bits")).toArrow()
    filter_bits = np.zeros(FILTER_BITS // 32, np.uint32)
    filter_bits[np.asarray(cells.column("cell"))] = np.asarray(cells.column("bits")).astype(np.uint32)
    shared = docs.sparkSession.sparkContext.broadcast(filter_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, texts in text_slices(batch.column("text"), SLICE):
                tokens, counts = shingle_sets(texts, size)
                nodes, ends = node_ids(tokens, counts), np.cumsum(counts)
                at = nodes % FILTER_BITS
                hit = np.flatnonzero((shared.value[at >> 5] >> (at & 31).astype(np.uint32)) & 1 & (counts > 0))
                hit = [i for i in hit if int(nodes[i]) not in seen]
                seen.update(nodes[hit].tolist())
                if len(seen) > REMEMBERED:
                    seen.clear()
                yield pa.record_batch([pa.array(nodes[hit], pa.int64()), pa.array([tokens[ends[i] - counts[i] : ends[i]].tobytes() for i in hit], pa.binary())], names=["node", "tokens"])

    return docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("text <> ''").mapInArrow(run, "node long, tokens binary")


def _met_links(met: DataFrame, num: int, den: int) -> DataFrame:
    """(u, v) forests of exact links within each (root, x, y) of (root, x, y, node, known, tokens) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, nodes, known, sets_now = None, [], [], []

        def done() -> pa.RecordBatch:
            links = linked_sets(sets_now, num, den, known)
            return pa.record_batch([pa.array([nodes[i[k]] for i in links], pa.int64()) for k in (0, 1)], names=["u", "v"])

        for batch in batches:
            groups = zip(*[batch.column(c).to_pylist() for c in ("root", "x", "y")], strict=True)
            for group, node, label, tokens in zip(groups, batch.column("node").to_pylist(), batch.column("known").to_pylist(), batch.column("tokens"), strict=True):
                if group != now:
                    if len(nodes) > 1:
                        yield done()
                    now, nodes, known, sets_now = group, [], [], []
                nodes.append(node)
                known.append(label)
                sets_now.append(np.frombuffer(tokens.as_buffer(), U))
        if len(nodes) > 1:
            yield done()

    dealt = met.select("root", "x", "y", "node", "known", "tokens").repartition("root", "x", "y").sortWithinPartitions("root", "x", "y", "node")
    return dealt.mapInArrow(run, "u long, v long")


def _salted(rows: DataFrame, table: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join a table with one row per key to (node, ...) rows; the rows of a key are dealt to many tasks."""
    salt = F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")
    many = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", salt).join(many, [*on, "salt"], how).drop("salt")


def exact_components(sets: DataFrame, clusters: DataFrame, sizes: DataFrame, num: int, den: int) -> DataFrame:
    """(node, root) of the exact links within clusters (node, root); ``sizes`` has (node, n_shingles).

    A cluster too large for one task is cut into blocks. First every block is
    compared in itself and with a few leaders, which joins most groups of near
    copies. Only clusters that are still in several components go on: their
    sets are dealt to blocks by component, and two blocks meet unless they hold
    the same component and nothing else.
    """
    kept = checkpoint(sets.groupBy("node").agg(F.first("tokens").alias("tokens")))
    members = clusters.join(sizes, "node")
    weight = members.groupBy("root").agg(F.greatest(F.ceil(F.sum("n_shingles") / TOKENS), F.ceil(F.count(F.lit(1)) / SETS)).cast("int").alias("blocks"))
    placed = checkpoint(_salted(members, weight, ["root"]).select("root", "node", "blocks", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int").alias("x")))
    large = placed.where("blocks > 1")
    first = Window.partitionBy("root").orderBy(F.xxhash64("node"), "node")
    leaders = large.withColumn("turn", F.row_number().over(first)).where(F.col("turn") <= LEADERS).withColumn("own", F.col("x"))
    leaders = leaders.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("x <> own")
    met = placed.select("root", "node", "x").unionByName(leaders.select("root", "node", "x"))
    links = _met_links(met.select("root", "x", F.col("x").alias("y"), "node", F.col("node").alias("known")).join(kept, "node"), num, den)
    joined = checkpoint(components(links))
    if large.isEmpty():
        return joined
    labelled = large.select("root", "node").join(joined.select("node", F.col("root").alias("label")), "node", "left").withColumn("label", F.coalesce("label", "node"))
    labels = labelled.groupBy("root", "label").agg(F.count(F.lit(1)).alias("n"))
    open_roots = checkpoint(labels.groupBy("root").agg(F.count(F.lit(1)).alias("labels"), F.sum(F.when(F.col("n") < SETS, F.col("n"))).alias("small")).where("labels > 1"))
    if open_roots.isEmpty():
        return joined
    own = labels.where(F.col("n") >= SETS).select("root", "label", F.col("label").alias("pure"), F.ceil(F.col("n") / SETS).cast("int").alias("own_blocks"))
    rest = _salted(labelled, open_roots.select("root", F.greatest(F.ceil(F.col("small") / SETS), F.lit(1)).cast("int").alias("mixed")), ["root"])
    split = _salted(rest, own, ["root", "label"], "left")
    part = F.when(F.col("pure").isNull(), F.pmod(F.xxhash64("label"), F.col("mixed"))).otherwise(F.pmod(F.xxhash64("node"), F.col("own_blocks")))
    dealt = checkpoint(split.select("root", "node", F.col("label").alias("known"), F.struct(F.coalesce("pure", F.lit(0)).alias("pure"), F.col("pure").isNull().alias("mixed"), part.cast("int").alias("part")).alias("block")))
    blocks = dealt.select("root", "block").distinct()
    pairs = blocks.select("root", F.col("block").alias("x")).join(blocks.select("root", F.col("block").alias("y")), "root")
    pairs = pairs.where((F.col("x") < F.col("y")) & (F.col("x.mixed") | F.col("y.mixed") | (F.col("x.pure") != F.col("y.pure"))) | ((F.col("x") == F.col("y")) & F.col("x.mixed")))
    sides = pairs.select("root", "x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("block"))
    again = dealt.join(sides, ["root", "block"]).select("root", F.xxhash64("x").alias("x"), F.xxhash64("y").alias("y"), "node", "known").join(kept, "node")
    # What is linked here are components: their roots are joined, and their members follow.
    name = dealt.select("node", "known")
    more = _met_links(again, num, den).join(name.select(F.col("node").alias("u"), F.col("known").alias("a")), "u").join(name.select(F.col("node").alias("v"), F.col("known").alias("b")), "v")
    merged = components(more.select(F.col("a").alias("u"), F.col("b").alias("v")))
    # A set without a link so far is a component of its own.
    every = joined.unionByName(name.where("node = known").join(joined, "node", "left_anti").select("node", F.col("known").alias("root")))
    moved = merged.select(F.col("node").alias("root"), F.col("root").alias("to"))
    return every.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root"))


def classes(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, node, component_id) of every row.

    ``component_id`` is the smallest id reachable by links, its own included.
    """
    scheme = Scheme(num, den)
    nodes = checkpoint(document_nodes(docs, size, id_col, text_col))
    clusters = components(candidate_links(_keyed(docs, size, scheme, text_col)))
    each = nodes.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("least"), F.max("n_shingles").alias("n_shingles"))
    roots = exact_components(_sets(docs, size, clusters, text_col), clusters, each.select("node", "n_shingles"), num, den)
    least = each.select("node", "least")
    rooted = least.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "least")
    named = rooted.groupBy("root").agg(F.min("least").alias("component"))
    table = rooted.join(named, "root").select("node", "component")
    return nodes.join(table, "node", "left").select("doc_id", "n_shingles", "node", F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with one of each component: the smallest id, and one row of that.

    Rows without shingles are linked with nothing and stay, each of them, and so
    do rows without an id. Rows with the same id are one document.
    """
    found = classes(docs, size, num, den, id_col, text_col)
    chosen = found.where("n_shingles > 0 and doc_id = component_id").select(F.col("doc_id").alias("kept_id")).distinct()
    packed = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    alone = F.col("doc_id").isNull() | ~F.col("text").rlike(HAS_WORD)
    without = packed.where(alone).select("row")
    met = packed.where(~alone).join(chosen, F.col("doc_id") == F.col("kept_id"))
    # Repeated rows of the chosen id: the first by text.
    only = met.groupBy("doc_id").agg(F.min_by("row", "text").alias("row")).select("row")
    return only.unionByName(without).select("row.*")
