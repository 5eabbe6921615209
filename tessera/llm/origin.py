"""Problem 7: generated, minified and vendored files, and data saved as code.

Every chunk is read as tokens with names, numbers and strings masked. Runs of five masked tokens are min-hashed and banded. A
band bucket is sorted by size of set; the first class and each one a tenth larger than the last leader is a leader, and every
member is compared with the two leaders before it. Pairs whose exact Jaccard similarity reaches 0.8 are tied; the connected
classes are the clusters. Signs in a chunk (a generator's or upstream's header, a path no person writes to,
minified lines, lists numbered by a tool, literals and nothing else) seed its file. Clusters spread seeds. Across projects, a
member of the same file name as an upstream's copy is vendored, edited or not. Within a project, the members of a cluster are a
family: if most of its files are a generator's, the rest are too. Both need a masked set rich enough to tell one code from
another, or equal text. Masking hides line breaks, so a hand-written original is in one cluster with its minified build; that
mark and that of literals alone show in the text itself and stay where they are. A text that stands unchanged under one path
in many projects is vendored without any sign. One seeded chunk marks the file.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.shingles import mix, pack, shingle_hashes, verify
from tessera.session import norm_key, stage, union_all

WIDTH, SIMILAR, BANDS, ROWS, LEAD = 5, 0.8, 16, 7, 0.9
#: Of one bit of each of the 112 min-hash values, so many may differ: a pair of similarity 0.8 that meets in a band has 10.5 on
#: average, with a deviation of 3.1.
BITS_APART = 20
MANY_PROJECTS = 6
#: Distinct masked shingles from which on a cluster spreads marks between unequal texts; a plain list or a short comment has fewer.
SHAPE = 20
GENERATED, MINIFIED, VENDORED, BLOB, NUMBERED = 1, 2, 4, 8, 16

_TOKENS = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|[A-Za-z_$][\w$]*|\d[\w.]*|[^\s\w]")
#: Words that keep their meaning when names are masked; fixed values.
KEYWORDS = frozenset(
    "def class return if else elif for while const let var function async await import from export public private protected static final void new func package type struct "
    "switch case range go defer in not and or None True False null nil true false self this try except catch finally throw raise with as lambda assert yield interface extends "
    "implements enum int string String bool".split()
)
_COMMENT = re.compile(r"^\s*(?://|#|/\*|\*|--|<!--|;|%|\"\"\"|''')")
_LEAD = re.compile(r"^\s*(?://+!?|#+!?|/\*+!?|\*+|--+|<!--|;+|%+|\"\"\"|''')\s*")
_GEN_HEAD = re.compile(
    r"(?i)^(?:@generated\b|code generated\b.*\bdo not (?:edit|modify)|<auto-?generated|auto-?generated(?: file| code| by| from|\s*[-:.])|automatically generated\b|machine[- ]generated\b"
    r"|(?:this|the following) (?:file|code|source|class|module) (?:was|is|has been) (?:auto(?:matically)?[- ]?)(?:produced|generated|created|built|written)"
    r"|(?:this|the following) (?:file|code|source|class|module) (?:was|is|has been) generated (?:by|from|with)"
    r"|generated (?:by|from|using|with) (?:the )?[\w./-]+(?: compiler| v?\d|\s*[.:;(]|$)|do not edit(?: by hand| manually)?\s*[:;.-].*|generated code\b.*do not)"
)
_VENDOR_HEAD = re.compile(
    r"(?i)^(?:upstream:?\s+[\w.@/-]+\s+v?\d+\.\d+|[\w.@/-]+ v?\d+\.\d+(?:\.\d+)?\s*(?:\||-|–)\s*(?:\(c\)|©|copyright|copied|licen[sc]ed|released|imported|vendored)"
    r"|copyright\b.{0,80}\bversion v?\d+\.\d+|(?:vendored|imported|copied|bundled)(?: unchanged| verbatim| as is)? from (?:the )?(?:upstream|[\w.@/-]+ v?\d+\.\d+))"
)
_VENDOR_PATH = re.compile(
    r"(?:^|/)(?:node_modules|bower_components|jspm_packages|_vendor|site-packages|dist-packages)/|(?:^|/)vendor/(?:[\w.@-]+/)+|(?:^|/)third[_-]?party/[\w.@-]+/|(?:^|/)Godeps/_workspace/|(?:^|/)(?:external|deps)/[\w.@-]+/"
    r"|/static/(?:js|css)/lib/|(?:^|/)(?:js|lib|libs|javascripts)/[a-z][\w]*-\d+\.\d+(?:\.\d+)?\.\w+$"
)
_GEN_PATH = re.compile(r"(?:^|/)__generated__/|/build/generated/|\.pb\.(?:go|cc|h)$|_pb2(?:_grpc)?\.pyi?$|\.generated\.\w+$|(?:^|/)zz_generated[._]|\.g\.(?:dart|cs)$|\.designer\.cs$", re.I)
_LOCK = re.compile(r"(?:^|/)(?:package-lock\.json|npm-shrinkwrap\.json|yarn\.lock|pnpm-lock\.yaml|poetry\.lock|Pipfile\.lock|Cargo\.lock|composer\.lock|Gemfile\.lock|go\.sum|uv\.lock|gradle\.lockfile|packages\.lock\.json|flake\.lock|mix\.lock|pubspec\.lock|Podfile\.lock|bun\.lock)$", re.I)
_MIN_PATH = re.compile(r"\.min\.(?:js|css|mjs)$|[-.]bundle\.js$|(?:^|/)dist/[\w.-]+\.[0-9a-f]{6,}\.(?:js|css)$", re.I)
_CODE_EXT = frozenset("py js ts tsx jsx mjs cjs java go kt rs c cc cpp h cs rb php swift scala sh sql tf".split())
_STATEMENT = re.compile(r"^\s*(?:def|class|return|if|for|while|func|function|public|private|import|from|export (?:default )?(?:async )?(?:function|class)|switch|try|async|await)\b|\)\s*(?:\{|=>)\s*$|=>\s*\{", re.M)
_NUMBERED = re.compile(r"_\d{3,5}_[A-Za-z]\w*\s*[=:]")
_STRING = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'")
_LITERAL = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|[-+]?(?:0x[0-9a-fA-F]+|\d[\w.]*)|[\[\](){},;+\s]")
_ENCODED = re.compile(r"[A-Za-z0-9+/=_-]{24,}[`\"']?[;,)]*\s*$")
_WRAPPER = re.compile(r"^\s*(?:public |final |static |export )*(?:class|object|module) \w+ \{[^()]*=\s*[\[{(\"'`]?\s*$", re.M)


def masked(token: str) -> str:
    """A name is I, a number 0, a string S; key words and signs stay."""
    c = token[0]
    if c in "\"'" and len(token) > 1:
        return "S"
    if c.isdigit():
        return "0"
    if c.isalpha() or c in "_$":
        return token if token in KEYWORDS else "I"
    return c


def masked_hashes(text: str, cache: dict[str, int]) -> np.ndarray:
    """Hashes of the masked tokens of a text."""
    if len(cache) > 400_000:
        cache.clear()
    found = _TOKENS.findall(text)
    out = np.empty(len(found), np.uint64)
    for i, t in enumerate(found):
        h = cache.get(t)
        if h is None:
            h = cache[t] = xxhash.xxh64_intdigest(masked(t))
        out[i] = h
    return out


def is_minified(text: str) -> bool:
    """Most of the text stands in long, dense lines whose names have one or two letters."""
    total = dense = 0
    for line in text.split("\n"):
        total += len(line)
        if len(line) < 200:
            continue
        bare = _STRING.sub('""', line)
        names = [n for n in re.findall(r"[A-Za-z_$][\w$]*", bare) if n not in KEYWORDS]
        short = sum(len(n) <= 2 for n in names)
        if len(names) >= 15 and short >= 0.45 * len(names) and bare.count(" ") < 0.12 * len(bare) and sum(bare.count(c) for c in ";{}(),=") > 0.08 * len(bare):
            dense += len(line)
    return total >= 200 and dense >= 0.6 * total


def is_data_line(line: str) -> bool:
    """Nothing but literals and separators, or one run of encoded bytes."""
    bare = line.strip()
    return bool(_ENCODED.match(bare)) or not _LITERAL.sub("", bare)


def is_blob(text: str, path: str) -> bool:
    """Code that holds literals and nothing else: one assignment around lines of numbers, strings or encoded bytes."""
    ext = path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    if ext not in _CODE_EXT:
        return False
    text = _WRAPPER.sub("", text)
    if _STATEMENT.search(text):
        return False
    lines = [x for x in text.split("\n") if x.strip() and not _COMMENT.match(x)]
    if len(lines) < 4:
        return len(lines) > 0 and max(map(len, lines)) > 800 and bool(re.search(r"[A-Za-z0-9+/=]{600,}|(?:\\x[0-9a-f]{2}){100,}|(?:\d+,\s*){150,}", text))
    data = sum(map(is_data_line, lines))
    return data >= len(lines) - 3 and data >= 0.75 * len(lines)


def signs(path: str, text: str) -> int:
    """The signs a chunk and its path give, as bits."""
    bits = 0
    if _VENDOR_PATH.search(path):
        bits |= VENDORED
    if _GEN_PATH.search(path) or _LOCK.search(path):
        bits |= GENERATED
    if _MIN_PATH.search(path):
        bits |= MINIFIED
    if not text:
        return bits
    at = 0
    while at < len(text):  # a header: only comments and blank lines before it, however long
        end = text.find("\n", at)
        line, at = (text[at:], len(text)) if end < 0 else (text[at:end], end + 1)
        if not line.strip() or line.startswith(("package ", "'use strict'", '"use strict"')):
            continue
        if not _COMMENT.match(line):
            break
        said = _LEAD.sub("", line)
        if _GEN_HEAD.match(said):
            bits |= GENERATED
        if _VENDOR_HEAD.match(said):
            bits |= VENDORED
    if len(_NUMBERED.findall(text)) >= 6:
        bits |= NUMBERED
    if is_minified(text):
        bits |= MINIFIED
    if is_blob(text, path):
        bits |= BLOB
    return bits


def features(chunks: DataFrame) -> DataFrame:
    """(project, path, bits, raw, cls, c8, n, blob, bands, s1, s2) of every chunk of a project; s1 and s2 hold a bit a min-hash value.

    The set, the bands and the bits stand in the first row of a class in a task and are null in the others.
    """
    rng = np.random.default_rng(707)
    mul = rng.integers(1, 1 << 62, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
    add = rng.integers(1, 1 << 62, BANDS * ROWS, dtype=np.uint64)

    def bands(hashes: np.ndarray) -> tuple[list[int], int, int]:
        hs = mix(hashes)
        low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(hs), 2048):
            np.minimum(low, (hs[at : at + 2048, None] * mul + add).min(axis=0), out=low)
        band = low.reshape(BANDS, ROWS)
        key = band[:, 0].copy()
        for r in range(1, ROWS):
            key = mix(key) + band[:, r]
        keys = mix(key + np.arange(BANDS, dtype=np.uint64)).view(np.int64).tolist()
        bit = np.packbits((mix(low) >> np.uint64(60)).astype(np.uint8) & 1, bitorder="little").tobytes()
        half = len(bit) // 2
        return keys, int.from_bytes(bit[:half], "little"), int.from_bytes(bit[half:], "little")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict[str, int] = {}
        seen: set[bytes] = set()
        for batch in batches:
            rows = []
            for project, path, text in zip(batch["project"], batch["file_path"], batch["content"]):
                text = text or ""
                bits = signs(path, text)
                hashes = shingle_hashes(masked_hashes(text, cache), WIDTH)
                raw = xxhash.xxh64_intdigest(" ".join(text.split())) - (1 << 63)
                if len(hashes) < 2:
                    rows.append((project, path, bits, raw, None, None, 0, None, None, None, None))
                    continue
                blob = pack(hashes)
                cls = xxhash.xxh3_128_digest(blob)
                again = cls in seen
                if len(seen) > 400_000:
                    seen.clear()
                seen.add(cls)
                keys, s1, s2 = (None, None, None) if again else bands(hashes)
                rows.append((project, path, bits, raw, cls, int.from_bytes(cls[:8], "big", signed=True), len(hashes), None if again else blob, keys, s1, s2))
            if rows:
                yield pd.DataFrame(rows, columns=["project", "path", "bits", "raw", "cls", "c8", "n", "blob", "bands", "s1", "s2"]).astype({"c8": "Int64", "s1": "Int64", "s2": "Int64"})

    src = chunks.select(norm_key(F.col("project_id")).alias("project"), "file_path", "content").where("project is not null and file_path is not null")
    return src.mapInPandas(run, "project string, path string, bits int, raw bigint, cls binary, c8 bigint, n int, blob binary, bands array<bigint>, s1 bigint, s2 bigint")


def leaders(band: np.ndarray, n: np.ndarray, c8: np.ndarray, s1: np.ndarray, s2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(member, leader) row pairs to compare; rows are sorted by band, then n. At most two pairs a row.

    Pairs whose sizes or min-hash bits are too far apart for the similarity are left out.
    """
    start = np.flatnonzero(np.r_[True, band[1:] != band[:-1]])
    group = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(band)]))
    place = group.astype(np.int64) << 32 | n.astype(np.int64)
    ends = np.r_[start[1:], len(band)]
    head, before, stop = start, np.full(len(start), -1), ends
    left, right = [], []
    while len(head):
        reach = np.searchsorted(place, (group[head].astype(np.int64) << 32) + np.floor(n[head] / LEAD).astype(np.int64), "right")
        reach = np.minimum(reach, stop)
        for lead, first in ((head, head + 1), (before, head)):  # the leader's own members, and what the one before it may reach
            size = np.where(lead >= 0, np.maximum(reach - first, 0), 0)
            rows = np.repeat(first - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
            by = np.repeat(lead, size)
            ok = (n[by] >= SIMILAR * n[rows] - 1e-9) & (c8[by] != c8[rows])
            ok &= np.bitwise_count(s1[by] ^ s1[rows]).astype(int) + np.bitwise_count(s2[by] ^ s2[rows]) <= BITS_APART
            left.append(rows[ok])
            right.append(by[ok])
        more = reach < stop
        head, before, stop = reach[more], head[more], stop[more]
    return np.concatenate(left), np.concatenate(right)


def clusters(feats: DataFrame) -> DataFrame:
    """(cls, root): classes tied by verified similarity; a class tied to none is its own root and has no row."""
    classes = feats.where("blob is not null").select("cls", "c8", "n", "blob")
    banded = feats.where("blob is not null").select(F.explode("bands").alias("band"), "n", "c8", "s1", "s2").repartition("band").sortWithinPartitions("band", "n", "c8")

    def star(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] | None = None  # the rows of the last bucket, which may go on in the next batch
        for batch in batches:
            rows = [batch[c].to_numpy() for c in ("band", "n", "c8", "s1", "s2")]
            if held is not None:
                rows = [np.concatenate([h, r]) for h, r in zip(held, rows)]
            if not len(rows[0]):
                continue
            cut = int(np.searchsorted(rows[0], rows[0][-1], "left"))
            held, ready = [r[cut:] for r in rows], [r[:cut] for r in rows]
            if cut:
                x, y = leaders(*ready)
                if len(x):
                    yield pd.DataFrame({"a": ready[2][x], "b": ready[2][y]})
        if held is not None:
            x, y = leaders(*held)
            if len(x):
                yield pd.DataFrame({"a": held[2][x], "b": held[2][y]})

    met = banded.mapInPandas(star, "a bigint, b bigint")
    pairs = stage(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "stars")
    return components(verify(pairs, classes, SIMILAR).select("a", "b"))


def origins(chunks: DataFrame) -> DataFrame:
    """(project_id, file_path, kinds) of the files that are not hand-written; kinds is a sorted array.

    Chunks without project or path take part in nothing. A file without any sign and outside every spreading cluster is
    hand-written and gives no row.
    """
    feats = stage(features(chunks), "features")
    roots = clusters(feats)
    # the path below the repository folder, and the plain file name
    rel = F.regexp_replace("path", "^[^/]*/", "")
    name = F.element_at(F.split("path", "/"), -1)
    c = feats.select("project", "path", "bits", "raw", "cls", "n").join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left")
    c = stage(c.withColumn("root", F.coalesce("root", "cls")).withColumn("rel", rel).withColumn("name", name), "chunks").where("root is not null")
    seed = feats.groupBy("project", "path").agg(F.bit_or("bits").alias("file_bits")).where("file_bits > 0")
    # numbered lists: one repeated shape, counted through; many such lines a tool wrote
    own = stage(seed.withColumn("file_bits", F.when(F.col("file_bits").bitwiseAND(NUMBERED) > 0, F.col("file_bits").bitwiseOR(GENERATED)).otherwise(F.col("file_bits"))), "marked")
    # what the marked files give to others is few beside all chunks; each list is staged, so that Spark knows its size and sends
    # it to the chunks while it is small
    up = c.join(own.where(F.col("file_bits").bitwiseAND(VENDORED) > 0), ["project", "path"])
    ends = [F.min("project").alias("p1"), F.max("project").alias("p2")]
    copied = stage(up.groupBy("root", "name", "raw").agg(*ends), "copied")
    spread_v = c.join(copied, ["root", "name", "raw"]).where("project <> p1 or project <> p2").select("project", "path", F.lit(VENDORED).alias("file_bits"))
    rich = c.where(F.col("n") >= SHAPE)
    named = stage(up.where(F.col("n") >= SHAPE).groupBy("root", "name").agg(*ends), "named")
    spread_n = rich.join(named, ["root", "name"]).where("project <> p1 or project <> p2").select("project", "path", F.lit(VENDORED).alias("file_bits"))
    made = rich.join(own.where(F.col("file_bits").bitwiseAND(GENERATED) > 0), ["project", "path"]).select("root", "project", "path").distinct()
    some = stage(made.groupBy("root", "project").agg(F.count("*").alias("g")).where("g >= 2"), "families")
    family = rich.join(some, ["root", "project"]).select("root", "project", "path", "g").distinct()
    most = stage(family.groupBy("root", "project").agg(F.count("*").alias("k"), F.max("g").alias("g")).where("2 * g > k and g < k").select("root", "project"), "most")
    spread_g = family.join(most, ["root", "project"], "left_semi").select("project", "path", F.lit(GENERATED).alias("file_bits"))
    # texts under one path in many projects: found by hashes, then by the values themselves
    keyed = c.withColumn("h", F.xxhash64("root", "rel", "raw"))
    often = stage(keyed.groupBy("h").agg(F.countDistinct(F.xxhash64("project")).alias("k")).where(F.col("k") >= MANY_PROJECTS).select("h"), "often")
    again = keyed.join(often, "h", "left_semi")
    wide = again.groupBy("root", "rel", "raw").agg(F.countDistinct("project").alias("k")).where(F.col("k") >= MANY_PROJECTS).select("root", "rel", "raw")
    spread_w = again.join(wide, ["root", "rel", "raw"], "left_semi").select("project", "path", F.lit(VENDORED).alias("file_bits"))
    all_bits = union_all([own, spread_v, spread_n, spread_g, spread_w]).groupBy("project", "path").agg(F.bit_or("file_bits").alias("bits"))
    kinds = F.array_compact(F.array(*[F.when(F.col("bits").bitwiseAND(b) > 0, F.lit(k)) for k, b in (("blob", BLOB), ("generated", GENERATED), ("minified", MINIFIED), ("vendored", VENDORED))]))
    return all_bits.select(F.col("project").alias("project_id"), F.col("path").alias("file_path"), kinds.alias("kinds")).where("size(kinds) > 0")
