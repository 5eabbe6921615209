"""Problem 10: per-document text statistics, and a Gaussian mixture that tells prose from lists, tables and junk.

The statistics of all documents are standardised with the corpus mean and deviation; expectation-maximization runs over all
documents, one pass per round in which every partition returns only its sufficient statistics (components x dimensions).
Components take the class of the inspected examples below that they hold; a document's class is the most probable one.
"""

from __future__ import annotations

import logging
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import stage

COMPONENTS, ROUNDS, SEED_ROWS, FLOOR = 16, 20, 4000, 1e-2
DOUBT = 1e-3
TOLERANCE = 1e-3
CLASSES = ("prose", "list", "table", "junk")

#: Frequent function words of English, German, Spanish and French; fixed values.
COMMON = frozenset(
    "the a an and or but nor of to in on at by for from with without into onto over under behind before after until unless while when whenever where because so that this these those than then there here "
    "as if not must should would could can may might will shall is are was were be been being am do does did has have had it its we our you your he she they them their his her i my me us who which what "
    "each every one some any all both more most such no only very also although though even therefore however between during through about again once how why "
    "der die das den dem des ein eine einen einem einer eines und oder aber nicht ist sind war wird werden wurde hat haben auf aus bei mit nach von vor zu zum zur für im am als wenn weil dass ob bevor sobald ohne jede jeder jedes jeden alle allen sich es er sie wir ihr man noch nur auch danach um über unter "
    "el la los las un una unos unas y o pero no es son era fue ser está están ha han de del al en con sin por para que se su sus como cuando antes después porque si más cada este esta estos lo le les sobre entre hasta otra otro "
    "le les du des une et ou mais ne pas est sont était être ont dans sur avec sans pour par que qui se son sa ses ce cette ces comme quand avant après dès car si plus chaque au aux il elle nous vous ils leur l d s n qu tout toute toutes autre".split()
)
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_PREFIX = re.compile(r"^\s*(?:(?:[-*+•>#%;|]+|//+|/\*+|\d+[.)]|\[[ x]\]|\(\w\)|--+)\s+)+")
_MARKUP = re.compile(r"</?[A-Za-z][\w-]*(?: [^<>]*)?/?>|&(?:#\d+|[a-z]+);|(?<![\w*_])[*_]{1,3}(?=\w)|(?<=[\w.,;:!?])[*_]{1,3}(?![\w*_])|[\u200b-\u200d\ufeff\u00ad]")
_CJK = re.compile(r"[぀-ヿ㐀-鿿豈-﫿가-힯]")
_HEAVY = re.compile(r"[{}\[\]=<>|\\/*+~^@$%&#_]")
_CODE_WORD = re.compile(r"\w+_\w+|[a-z]+[A-Z]\w*|\w+\.\w+\(|\d{2,}|::|--\w")
_ASIDE = re.compile(r"\([\w-]+\)|`[^`]*`")
_MARK = re.compile(r"(?:[-*+•]|\d+[.)]|\[[ x]\])\s")
_COLUMNS = re.compile(r"^\|.*\||\t|\S {2,}\S|^[\w.-]+[:=]\s?\S+(?: \S+)?$|^[^,]{1,30}(?:,[^ ,][^,]*){2,}$|;[^ ]+;")
_DIGIT = re.compile(r"\d")
_END = re.compile(r"[.!?…:。！？؟][\"'”’)\]]*$")


_SEEN: dict[str, tuple[tuple[str, ...], int]] = {}


def word_parts(word: str) -> tuple[tuple[str, ...], int]:
    """(the lower-case parts of a word between apostrophes, how many of them are common); remembered, as words recur."""
    got = _SEEN.get(word)
    if got is None:
        if len(_SEEN) > 200_000:
            _SEEN.clear()
        low = word.lower()
        parts = tuple(re.split(r"['’]", low)) if "'" in low or "’" in low else (low,)
        got = _SEEN[word] = (parts, sum(p in COMMON for p in parts))
    return got


def sentence_line(line: str, words: list[str] | None = None) -> float | None:
    """How strongly a line reads as running text: 1 yes, 0 no, None too short to tell by itself.

    ``words`` are the line's words, where they are known already.
    """
    bare = line if words is not None and line[:1].isalpha() else _PREFIX.sub("", line).strip()
    if "&" in bare or "<" in bare or "*" in bare or "_" in bare:
        bare = _MARKUP.sub("", bare)
    if not bare:
        return 0.0
    solid = len(bare) - bare.count(" ")
    if not bare.isascii():
        cjk = len(_CJK.findall(bare))
        if cjk >= 0.4 * solid:
            return 1.0 if cjk >= 6 or _END.search(bare) else None
    if words is None or bare is not line:
        words = _WORD.findall(bare)
    letters = sum(map(len, words))
    if letters < 0.55 * solid:
        return 0.0
    heavy = len(_HEAVY.findall(bare)) + 2 * len(_CODE_WORD.findall(_ASIDE.sub("", bare) if "(" in bare or "`" in bare else bare))
    if heavy > 1 and heavy > 0.06 * len(bare):
        return 0.0
    parts: list[str] = []
    common = 0
    for w in words:
        p, n = word_parts(w)
        parts += p
        common += n
    if len(words) < 5:
        return None if common or _END.search(bare) else 0.0
    kinds = len(set(parts))
    if len(parts) >= 8 and kinds < 0.35 * len(parts):  # a heap of repeated words
        return 0.0
    if common >= 0.17 * len(words):
        return 1.0
    return None if common >= 0.1 * len(words) else 0.0


STATS = ("words", "mean_word", "symbols", "digits", "ended_lines", "common", "line_length", "distinct", "sentences", "cjk", "marked", "columns")


def statistics(text: str) -> tuple[float, ...]:
    """The statistics of a text that is not blank, in the order of ``STATS``.

    Log word count, mean word length, symbol and digit share of the characters, share of lines ending in punctuation, share
    of common words, log mean line length, share of distinct words, share of characters in sentences, share of CJK characters, share
    of lines that start with a list mark, share of lines that look like columns. A line is read once; wrapped lines count with
    the line before.
    """
    n = letters = words = common = n_lines = ended = marked = columns = 0
    kinds: set[tuple[str, ...]] = set()
    running = 0
    last = 0.0
    held = 0  # characters of short lines that wait for what follows
    for line in text.replace("\r", "\n").split("\n"):
        bare = line.strip()
        if not bare:
            last, held = 0.0, 0
            continue
        size = len("".join(bare.split()))
        found = _WORD.findall(bare)
        n += size
        n_lines += 1
        words += len(found)
        letters += sum(map(len, found))
        for w in found:
            parts, c = word_parts(w)
            kinds.add(parts)
            common += c
        ended += bool(_END.search(bare))
        marked += bool(_MARK.match(bare))
        columns += bool(_COLUMNS.search(bare))
        v = sentence_line(bare, found)
        if v is None:
            if last == 1.0:
                running += size
            else:
                held += size
            continue
        if v == 1.0:
            running += size + held
        held, last = 0, v
    cjk = 0 if text.isascii() else len(_CJK.findall(text))
    digits = len(_DIGIT.findall(text))
    whole, lines = max(1, n), max(1, n_lines)
    return (
        float(np.log1p(words + cjk / 2)),
        min(20.0, letters / max(1, words)),
        max(0, whole - letters - digits) / whole,
        digits / whole,
        ended / lines,
        common / max(1, words),
        float(np.log1p(whole / lines)),
        len(kinds) / max(1, words),
        running / whole,
        cjk / whole,
        marked / lines,
        columns / lines,
    )


def sentence_share(text: str) -> float:
    """Share of the non-blank characters that stand in running sentences."""
    return statistics(text)[STATS.index("sentences")]


#: Inspected examples: texts whose class is plain, written for this purpose.
EXAMPLES = (
    ("prose", "The scheduler keeps a list of pending jobs and starts the next one when a worker is free. If no worker answers within a minute, the job goes back to the queue."),
    ("prose", "We moved the parser into its own module because it was hard to test. Nothing else has changed, and the old name still works until the next release."),
    ("prose", "on a cold start we read the whole index from disk so that the first query is not slow\nthe cost is a few seconds and it is paid only once"),
    ("prose", "WE KEEP THE OLD FORMAT FOR ONE MORE RELEASE.\nTHE READER ACCEPTS BOTH."),
    ("prose", "Der Dienst schreibt jede Änderung in das Protokoll, bevor er den Index ersetzt. Danach prüft er die alten Einträge."),
    ("prose", "El servicio lee los cambios y después escribe un resumen. Cuando termina la carga, el índice queda listo."),
    ("prose", "Le service lit les changements avant de lancer une autre tâche. La table est prête quand la charge est finie."),
    ("prose", "索引は更新が終わると古い記録を置き換える。計画部は次の作業の前に新しいファイルを確認する。"),
    ("prose", "在更新完成以后，索引会替换旧的记录。监视器会检查新的文件。"),
    ("prose", "# Notes\n\nEach shard holds its own copy of the table, and it is merged at night.\nThe merge is safe to stop, as every step is written twice."),
    ("list", "- green valve\n- small pump\n- spare filter\n- long hose\n- steel ring\n- copper wire\n- glass tube\n- rubber seal"),
    ("list", "1. `load_table`\n2. `merge_rows`\n3. `write_index`\n4. `drop_cache`\n5. `scan_files`\n6. `count_lines`"),
    ("list", "[ ] src/main/Reader.java\n[ ] src/lib/writer.py\n[ ] tools/build/run.sh\n[ ] app/core/index.ts\n[ ] pkg/util/walk.go"),
    ("list", "* Pump;\n* Valve;\n* Filter;\n* Hose;\n* Tank;\n* Meter;\n* Gauge;\n* Motor;"),
    ("table", "| name | size | state |\n|---|---|---|\n| pump | 12 | yes |\n| valve | 7.50 | no |\n| hose | 331 | n/a |\n| ring | 4 ms | - |"),
    ("table", "name,size,state,time\npump,12,yes,4 ms\nvalve,7.50,no,19 ms\nhose,331,n/a,-\nring,18,yes,77 ms\nwire,2.25,no,8 ms"),
    ("table", "pump_size: 12\nvalve_state: no\nhose_length: 7.50\nring_count: 331\nwire_time: 18 ms\ntube_kind: n/a\nseal_age: 12.01"),
    ("table", "pump        12.50       yes\nvalve       7.25        no\nhose        331         n/a\nring        18 ms       -"),
    ("junk", "2024-02-03T04:05:06Z INFO [pump-3] valve=12 ring=ab12cd34\n2024-02-03T04:05:07Z WARN [pump-4] valve=13 ring=ff00aa11\n2024-02-03T04:05:09Z INFO [pump-3] valve=99 ring=0b1c2d3e"),
    ("junk", "for (const a of pump.valves()) {\n  const b = ring.open(a, 12);\n  hose.map((x) => x.size + 3);\n}\nwhile (ring.count() < 7) {\n  tube = pump.next(a);\n}"),
    ("junk", "ValveError: 12\n    at openRing (pump/valve.js:12:4)\n    at readHose (pump/hose.js:331:18)\n    at main (app/index.js:7:2)\n    at run (app/run.js:44:9)"),
    ("junk", "00000000  12 ab 34 cd 56 ef 78 90 11 22 33 44 55 66 77 88\n00000010  99 aa bb cc dd ee ff 00 12 23 34 45 56 67 78 89\n00000020  a1 b2 c3 d4 e5 f6 07 18 29 3a 4b 5c 6d 7e 8f 90"),
    ("junk", "pump pump valve pump hose pump valve valve pump hose hose pump valve pump\nvalve pump pump hose valve pump valve pump hose valve pump pump hose"),
    ("junk", "hose! " * 60),
    ("junk", "pump, pump, pump, pump, valve, valve, valve, pump, pump, pump, pump, pump, valve, valve, pump, pump, pump, pump, pump, pump, valve, pump, pump."),
    ("junk", "Home > Docs | Search » Log in Home | Next » Previous Docs > Edit page | Search Home » Next > Log in | Docs » Previous"),
    ("junk", "=============================== ???\n********************************* !!!\n------------------------------\n############################ ~~~\n<<<<<<<<<<<<<<<<<<<<<<<<<<<"),
    ("junk", "aGVsbG8gd29ybGQgdGhpcyBpcyBub3QgYSBzZWNyZXQgYXQgYWxsIGJ1dCBieXRlcw0KaGVs\nbG8gd29ybGQgdGhpcyBpcyBub3QgYSBzZWNyZXQgYXQgYWxsIGJ1dCBieXRlcw0KaGVsbG8g"),
)


def document_stats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, *STATS) of every document that is not null or blank; the log columns as they enter the mixture."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, *statistics(t)) for k, t in zip(batch[key], batch[text]) if t is not None and t.strip()]
            if rows:
                yield pd.DataFrame(rows, columns=[key, *STATS])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).where(F.col(text).isNotNull()).mapInPandas(run, f"{key} {kind}, " + ", ".join(f"{c} double" for c in STATS))


class Mixture:
    """Gaussian mixture with full covariances over standardised statistics."""

    def __init__(self, weights: np.ndarray, means: np.ndarray, covs: np.ndarray, centre: np.ndarray, scale: np.ndarray):
        self.weights, self.means, self.covs, self.centre, self.scale = weights, means, covs, centre, scale
        self.labels = np.zeros(len(weights), int)
        self.rounds, self.converged = 0, False

    def standard(self, x: np.ndarray) -> np.ndarray:
        return (x - self.centre) / self.scale

    def responsibilities(self, z: np.ndarray) -> tuple[np.ndarray, float]:
        """(n x components probabilities, summed log likelihood)."""
        d = z.shape[1]
        logs = np.empty((len(z), len(self.weights)))
        for k, (w, m, c) in enumerate(zip(self.weights, self.means, self.covs)):
            low = np.linalg.cholesky(c)
            y = (z - m) @ np.linalg.inv(low).T
            logs[:, k] = np.log(w + 1e-300) - 0.5 * (y * y).sum(1) - np.log(np.diag(low)).sum() - 0.5 * d * np.log(2 * np.pi)
        top = logs.max(1, keepdims=True)
        p = np.exp(logs - top)
        s = p.sum(1, keepdims=True)
        return p / s, float((top + np.log(s)).sum())

    def updated(self, n: np.ndarray, s: np.ndarray, q: np.ndarray) -> Mixture:
        """The maximization step from summed responsibilities, first and second moments."""
        total = max(n.sum(), 1e-9)
        means, covs = self.means.copy(), self.covs.copy()
        for k in range(len(n)):
            if n[k] > 2 * len(self.centre):
                means[k] = s[k] / n[k]
                covs[k] = q[k] / n[k] - np.outer(means[k], means[k]) + FLOOR * np.eye(len(self.centre))
        return Mixture(np.maximum(n / total, 1e-9), means, covs, self.centre, self.scale)

    def label(self) -> None:
        """Give each component the class of the examples it holds; one that holds none takes the nearest example's class."""
        x = self.standard(np.array([statistics(t) for _, t in EXAMPLES]))
        r, _ = self.responsibilities(x)
        mass = np.zeros((len(self.weights), len(CLASSES)))
        for (name, _), row in zip(EXAMPLES, r):
            mass[:, CLASSES.index(name)] += row
        for k in range(len(self.weights)):
            if mass[k].sum() > 0.05:
                self.labels[k] = int(mass[k].argmax())
            else:
                gap = x - self.means[k]
                self.labels[k] = CLASSES.index(EXAMPLES[int((gap * gap).sum(1).argmin())][0])

    def class_probabilities(self, z: np.ndarray) -> np.ndarray:
        r, _ = self.responsibilities(z)
        out = np.zeros((len(z), len(CLASSES)))
        for k, c in enumerate(self.labels):
            out[:, c] += r[:, k]
        return out


def fit(stats: DataFrame, components: int = COMPONENTS, rounds: int = ROUNDS) -> Mixture:
    """Expectation-maximization over all rows; only the starting centres come from a bounded sample (SEED_ROWS rows).

    It ends when a round adds less than TOLERANCE to the mean log likelihood, or after ``rounds``; ``rounds`` and ``converged`` of
    the model, and the log, tell which.
    """
    cols = [F.col(c) for c in STATS]
    row = stats.agg(*[F.avg(c) for c in cols], *[F.stddev_pop(c) for c in cols], F.count("*")).collect()[0]
    d = len(STATS)
    total = row[2 * d]
    centre = np.array([v or 0.0 for v in row[:d]])
    scale = np.array([v if v and v > 1e-6 else 1.0 for v in row[d : 2 * d]])
    rng = np.random.default_rng(3)
    if total:
        share = min(1.0, SEED_ROWS / total)
        first = stats.columns[0]
        seed = stats.where(F.pmod(F.xxhash64(first, F.lit(29)), F.lit(1_000_000)) < int(share * 1_000_000) + 1).select(*STATS).limit(2 * SEED_ROWS).toPandas().to_numpy(float)
    else:
        seed = np.empty((0, d))
    shown = (np.array([statistics(t) for _, t in EXAMPLES]) - centre) / scale
    # one centre where the examples of each class lie, so that no class is without a component to begin with
    picks = [shown[[name == c for name, _ in EXAMPLES]].mean(0) for c in CLASSES]
    z = np.vstack([(seed - centre) / scale, shown])
    z = z[np.lexsort(z.T)]
    for _ in range(components - len(picks)):  # the rest far apart, by squared distance
        gap = np.min([((z - p) ** 2).sum(1) for p in picks], axis=0)
        picks.append(z[rng.choice(len(z), p=gap / gap.sum())] if gap.sum() > 0 else z[rng.integers(len(z))])
    model = Mixture(np.full(components, 1 / components), np.array(picks), np.array([np.eye(d) * 0.5] * components), centre, scale)
    last, done, settled = -np.inf, 0, not total
    while total and done < rounds and not settled:
        done += 1
        m = model

        def moments(batches: Iterator[pd.DataFrame], m: Mixture = m) -> Iterator[pd.DataFrame]:
            n, s, q, like = np.zeros(components), np.zeros((components, d)), np.zeros((components, d, d)), 0.0
            for batch in batches:
                if not len(batch):
                    continue
                x = m.standard(batch.to_numpy(float))
                r, ll = m.responsibilities(x)
                n += r.sum(0)
                s += r.T @ x
                q += np.einsum("nk,ni,nj->kij", r, x, x, optimize=True)
                like += ll
            yield pd.DataFrame({"k": np.arange(components), "n": n, "s": list(s), "q": list(q.reshape(components, -1)), "like": like / components})

        parts = stats.select(*STATS).mapInPandas(moments, "k int, n double, s array<double>, q array<double>, like double")
        add = [F.sum("n").alias("n"), F.sum("like").alias("like")]
        add += [F.array(*[F.sum(F.col("s")[i]) for i in range(d)]).alias("s"), F.array(*[F.sum(F.col("q")[i]) for i in range(d * d)]).alias("q")]
        rows = sorted(parts.groupBy("k").agg(*add).collect(), key=lambda r: r.k)
        model = model.updated(np.array([r.n for r in rows]), np.array([r.s for r in rows]), np.array([r.q for r in rows]).reshape(components, d, d))
        like = sum(r.like for r in rows) / total
        settled = like - last < TOLERANCE
        last = like
    model.rounds, model.converged = done, settled
    logging.getLogger(__name__).info("mixture: %d rounds, %s, mean log likelihood %.4f", done, "converged" if settled else "not converged", last)
    model.label()
    return model


def classify(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, *STATS, kind, prose_probability): statistics and most probable class of every document that is not blank.

    Repeated keys give repeated rows; an empty table gives none. The fit is deterministic for given rows.
    """
    stats = stage(document_stats(docs, key, text), "stats")
    model = stats.sparkSession.sparkContext.broadcast(fit(stats))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            m = model.value
            p = m.class_probabilities(m.standard(batch[list(STATS)].to_numpy(float)))
            yield batch.assign(kind=[CLASSES[i] for i in p.argmax(1)], prose_probability=p[:, 0])

    return stats.mapInPandas(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stats.schema) + ", kind string, prose_probability double")


def not_prose(classified: DataFrame) -> DataFrame:
    """Documents the mixture doesn't hold for prose beyond doubt, and whose running sentences are under half of the text."""
    return classified.where((F.col("prose_probability") < 1 - DOUBT) & (F.col("sentences") < 0.5))
