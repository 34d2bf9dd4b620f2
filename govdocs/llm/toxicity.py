"""Toxicity by a weighted finite-state pattern grammar over clauses.

Five transducers read the symbols of a clause: insults and threats write a weight, targets raise it,
negation and reported speech before it lower it. They are composed into one machine whose states are
the product of theirs, and which runs once over the symbols of each clause that holds an insult or a
threat. A document's score is the logistic of its clauses' weights. The insult vocabulary, words and stems
with their weights, and the logistic are fitted on labelled rows; everything else is the grammar.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from govdocs.llm.common import text_batches, text_or_empty

#: Closed word classes of the grammar in the languages of the corpus; fixed values.
TARGET = "you your yourself they them their he she him her people everyone du dich dir ihr euch sie er tu te toi vous ils elles il elle tú ti te usted ustedes ellos ellas él ella"
NEGATION = "not no never neither nor isn't aren't wasn't don't nicht kein keine nie niemals ne pas jamais aucun ni nunca jamás tampoco ningún"
REPORT = "said says say wrote writes claimed called quoted reported according sagte sagt schrieb laut dit disait écrit selon dijo dice escribió según"
THREAT = "kill hurt destroy beat shoot burn stab töten umbringen schlagen tuer frapper brûler matar golpear quemar"
BREAKS = ".!?;\n"
#: Labelled rows of each class that are fitted on, in expectation: a hash of doc_id takes an even share.
TRAIN_ROWS = 20_000
#: Vocabulary entries at most that training keeps, by evidence.
MOST_ENTRIES = 20_000
STEM = 4

WORDS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[" + re.escape(BREAKS) + "]")
SYMBOLS = ("other", "insult", "threat", "target", "negation", "report", "break")


@dataclass(frozen=True)
class Transducer:
    """step[state][symbol] = (next state, added, factor): what it adds to a symbol's weight, then multiplies it by."""

    step: tuple[dict[str, tuple[int, float, float]], ...]

    def at(self, state: int, symbol: str) -> tuple[int, float, float]:
        rules = self.step[state]
        return rules.get(symbol) or rules.get("*", (state, 0.0, 1.0))


def decaying(trigger: str, reach: int, added: float, factor: float) -> Transducer:
    """After trigger, the next `reach` symbols that carry weight get added and factor."""
    states = [{trigger: (reach, 0.0, 1.0)}]
    for left in range(1, reach + 1):
        carry = (left - 1, added, factor)
        states.append({trigger: (reach, 0.0, 1.0), "insult": carry, "threat": carry, "break": (0, 0.0, 1.0), "*": (left - 1, 0.0, 1.0)})
    return Transducer(tuple(states))


INSULT = Transducer(({"insult": (1, 0.0, 1.0)}, {"insult": (1, 0.5, 1.0), "break": (0, 0.0, 1.0)}))  # one more in the clause weighs more
THREATS = Transducer(({"threat": (1, 0.0, 1.0)}, {"target": (2, 0.0, 1.0), "break": (0, 0.0, 1.0)}, {"insult": (2, 1.0, 1.0), "threat": (2, 0.5, 1.0), "break": (0, 0.0, 1.0)}))
TARGETS = decaying("target", 6, 0.5, 1.0)
NEGATIONS = decaying("negation", 3, 0.0, 0.5)
REPORTS = decaying("report", 8, 0.0, 0.5)


def compose(parts: list[Transducer]) -> tuple[list[dict[str, tuple[int, float, float]]], int]:
    """One machine whose states are the reachable products of the parts' states; state 0 begins a clause."""
    number, todo, table = {(0,) * len(parts): 0}, [(0,) * len(parts)], []
    while todo:
        at = todo.pop(0)
        row = {}
        for symbol in SYMBOLS:
            moves = [p.at(s, symbol) for p, s in zip(parts, at)]
            to = tuple(m[0] for m in moves)
            if to not in number:
                number[to] = len(number)
                todo.append(to)
            row[symbol] = (number[to], sum(m[1] for m in moves), math.prod(m[2] for m in moves))
        table.append(row)
    return table, len(table)


MACHINE, _ = compose([INSULT, THREATS, TARGETS, NEGATIONS, REPORTS])
CLASSES = {w: c for c, ws in (("target", TARGET), ("negation", NEGATION), ("report", REPORT), ("threat", THREAT)) for w in ws.split()}
THREAT_WEIGHT = 0.3


def clause_weight(symbols: list[tuple[str, float]]) -> float:
    """The weight that the composed machine gives to the symbols of a clause."""
    state = total = 0
    for symbol, weight in symbols:
        state, added, factor = MACHINE[state][symbol]
        if weight:
            total += (weight + added) * factor
    return total


class Grammar:
    """The machine with a vocabulary: words and stems (prefixes, at least STEM letters) of insults."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.words, self.stems = words, stems
        self.sizes = sorted({len(s) for s in stems})

    def insult(self, word: str) -> float:
        best = self.words.get(word, 0.0)
        for n in self.sizes:
            if n > len(word):
                break
            best = max(best, self.stems.get(word[:n], 0.0))
        return best

    def features(self, text: str) -> tuple[float, float, float, int]:
        """Largest and summed clause weight, the logarithm of the number of words, and the clauses that match."""
        best = total = 0.0
        matched, clause, hit, words = 0, [], False, 0
        memo: dict[str, tuple[str, float]] = {}
        for token in WORDS.findall(text.lower()) + ["."]:
            if token in BREAKS:
                if hit:
                    weight = clause_weight(clause)
                    if weight > 0:
                        best, total, matched = max(best, weight), total + weight, matched + 1
                clause, hit = [], False
                continue
            symbol = memo.get(token)
            if symbol is None:
                weight = self.insult(token)
                kind = "insult" if weight else CLASSES.get(token, "other")
                symbol = memo[token] = (kind, weight or (THREAT_WEIGHT if kind == "threat" else 0.0))
            words += 1
            clause.append(symbol)
            hit = hit or symbol[1] > 0
        return round(best, 3), round(total, 3), round(math.log1p(words), 3), matched


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def held_out_column():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("None")).cast("binary")) % 5 == 0


@dataclass(frozen=True)
class Model:
    words: dict[str, float]
    stems: dict[str, float]
    #: Of the bias and of what inputs() gives.
    weights: tuple[float, ...]

    def score(self, features: tuple[float, float, float, int]) -> float:
        z = sum(w * x for w, x in zip(self.weights, inputs(*features[:3])))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def inputs(best: float, total: float, size: float) -> tuple[float, ...]:
    """Inputs of the logistic: the size counts only beside a match, so that texts without one score alike."""
    return 1.0, best, math.log1p(total), total / (1 + size), size * (total > 0)


def training_rows(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """text and toxic of labelled rows that aren't held out, about `most` of each class at most."""
    labels = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out_column())
    counts = {r.toxic: r.n for r in labels.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    steps = 1 << 20
    share = {k: min(steps, max(1, most * steps // n)) for k, n in counts.items()}
    limit = F.lit(0)
    for k, s in share.items():
        limit = F.when(F.col("toxic") == k, F.lit(s)).otherwise(limit)
    ids = labels.where(F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(steps)) < limit)
    # at most about 2 * most ids, so that they may be broadcast whatever the size of the corpus
    return docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(ids), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"))


def document_entries(text: str) -> set[str]:
    """Words and, marked with *, stems of a text."""
    words = {w for w in WORDS.findall(text.lower()) if w not in BREAKS}
    return words | {f"{w[:n]}*" for w in words for n in range(STEM, STEM + 4) if len(w) > n}


def entry_counts(rows: DataFrame) -> DataFrame:
    """entry, toxic and clean: documents with it, for entries that some toxic document has."""

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from collections import Counter

        for p in parts:
            seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
            for t, y in zip(p["text"], p["toxic"]):
                seen[int(y > 0)].update(document_entries(t))
            both = sorted(seen[0].keys() | seen[1].keys())
            yield pd.DataFrame({"entry": both, "toxic": [seen[1][e] for e in both], "clean": [seen[0][e] for e in both]})

    counted = rows.select("text", "toxic").mapInPandas(count, "entry string, toxic long, clean long")
    return counted.groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where("toxic > 0")


def logistic(rows, labels) -> tuple[float, ...]:
    """Weights by Newton's method, with a small penalty so that separable rows stay finite."""
    import numpy as np

    x, y = np.asarray(rows, dtype=float).T, np.asarray(labels, dtype=float)
    w = np.zeros(len(x))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
        hessian = (x * (p * (1 - p))) @ x.T + 0.1 * np.eye(len(x))
        step = np.linalg.solve(hessian, x @ (y - p) - 0.1 * w)
        w += np.clip(step, -2, 2)
        if abs(step).max() < 1e-6:
            break
    return tuple(map(float, w))


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS, least_docs: int = 3, least_share: float = 0.02, odds: float = 6.0) -> Model:
    """Vocabulary and logistic from about `most` rows a class that aren't held out.

    An entry stays if least_docs and least_share of the toxic documents have it and it is `odds` times as
    frequent among toxic rows as among clean ones, half a document of each added. Its weight is the log of the ratio.
    """
    text_batches(docs.sparkSession)
    rows = training_rows(docs, labels, most)
    sums = {int(r.toxic > 0): r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = sums.get(1, 0), sums.get(0, 0)
    if not n_toxic or not n_clean:
        return Model({}, {}, (-1.0, 1.0))
    ratio = ((F.col("toxic") + 0.5) / (n_toxic + 1.0)) / ((F.col("clean") + 0.5) / (n_clean + 1.0))
    chosen = entry_counts(rows).where(F.col("toxic") >= max(least_docs, least_share * n_toxic)).withColumn("ratio", ratio).where(F.col("ratio") >= odds)
    top = chosen.orderBy(F.desc("toxic"), "entry").limit(MOST_ENTRIES).collect()
    words = {r.entry: math.log(r.ratio) / 4 for r in top if not r.entry.endswith("*")}
    stems = {r.entry[:-1]: math.log(r.ratio) / 4 for r in top if r.entry.endswith("*")}
    grammar = Grammar(words, stems)

    def measure(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            found = [grammar.features(t)[:3] for t in p["text"]]
            yield pd.DataFrame(found, columns=["best", "total", "size"]).assign(toxic=p["toxic"].to_numpy())

    seen = rows.mapInPandas(measure, "best double, total double, size double, toxic int").toPandas()  # four numbers for each training row: bounded by 2 * most
    rows = [inputs(*r) for r in zip(seen["best"], seen["total"], seen["size"])]
    return Model(words, stems, logistic(rows, seen["toxic"] > 0))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, n_clauses of every row of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MOST_ENTRIES entries

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        grammar = Grammar(m.words, m.stems)
        for p in parts:
            found = [grammar.features(t) for t in p["text"]]
            s = [m.score(f) for f in found]
            yield pd.DataFrame({"doc_id": p["doc_id"].astype("Int64"), "held_out": p["held_out"], "score": s, "predicted": [int(x >= 0.5) for x in s], "n_clauses": [f[3] for f in found]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out_column().alias("held_out"), text_or_empty().alias("text"))
    return rows.mapInPandas(run, "doc_id long, held_out boolean, score double, predicted int, n_clauses int")


def toxicity(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted, n_clauses.

    Labels are learned only from rows whose crc32 of doc_id as text is not divisible by five. Null and
    empty texts get the score of a text without clauses. Labels without rows, null labels and null doc_ids
    teach nothing; without labels of both classes the score is that of an empty grammar. Rows that repeat a
    doc_id are scored each; an empty table gives an empty result; other columns are ignored.
    """
    return score(docs, fit(docs, labels, most))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that the grammar predicts as toxic; all columns are kept."""
    model = fit(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def toxic(texts: pd.Series) -> pd.Series:
        m = shared.value
        grammar = Grammar(m.words, m.stems)
        return pd.Series([m.score(grammar.features(t)) >= 0.5 for t in texts])

    return docs.where(~toxic(text_or_empty()))
