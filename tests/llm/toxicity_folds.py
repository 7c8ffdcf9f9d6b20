"""How the constants of the toxicity classifier are chosen: python tests/llm/toxicity_folds.py SF_DIR

Rows outside the held-out fold fall into three folds by the other remainders; each is judged by a model of the other two. Labels of
the held-out fold are not read. Prints, for each choice, the means of AUC, precision and recall at the threshold, F1, and log loss."""

import sys
import zlib
from itertools import product
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
from crawlweave.llm import toxicity as T  # noqa: E402

FOLDS = [f for f in range(T.HELD_OUT[0]) if f != T.HELD_OUT[1]]


class Corpus:
    def __init__(self, sf_dir: str):
        docs = pd.read_parquet(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"])
        labels = pd.read_parquet(f"{sf_dir}/labels.parquet", columns=["doc_id", "toxic"]).dropna().drop_duplicates("doc_id")
        self.fold = docs.doc_id.map(lambda x: zlib.crc32(str(x).encode()) % T.HELD_OUT[0]).to_numpy()
        labels = labels[labels.doc_id.isin(docs.doc_id[np.isin(self.fold, FOLDS)])]
        self.y = docs[["doc_id"]].merge(labels, on="doc_id", how="left").toxic.to_numpy(float)
        batch = pa.RecordBatch.from_arrays([pa.array([True] * len(docs)), pa.array(docs.doc_id), pa.array(docs.text, pa.string())], names=["positive", "row", "text"])
        parts = list(T._word_sets(iter([batch])))
        self.sets = [x.values.to_numpy() for b in parts for x in b.column(2)]
        self.bands = [x for b in parts for x in b.column(3).to_pylist()]
        self.words, self.at = np.unique(np.concatenate(self.sets), return_inverse=True)
        self.row = np.repeat(np.arange(len(docs)), [len(s) for s in self.sets])
        self.unlabelled = np.random.default_rng(7).permutation(len(docs))[: T.UNLABELLED]

    def counts(self, rows: np.ndarray) -> np.ndarray:
        return np.bincount(self.at[np.isin(self.row, rows)], minlength=len(self.words))

    def model(self, folds: list[int], decay: float) -> T.Model:
        known = np.isin(self.fold, folds) & ~np.isnan(self.y)
        rows = np.flatnonzero(known & (self.y == 1))
        rows = rows[T._without_copies([self.bands[i] for i in rows])]
        count, base = self.counts(rows), self.counts(self.unlabelled)
        often = np.flatnonzero(count >= 2)
        words = T.telling(self.words[often], count[often], base[often], len(rows), len(self.unlabelled))
        bits = lambda some: np.stack([np.packbits(np.isin(words, self.sets[i])) for i in some])
        return T.train(words, bits(rows), bits(self.unlabelled), self.y[known].mean(), decay=decay)

    def judged(self, model: T.Model, fold: int) -> list[float]:
        rows = np.flatnonzero((self.fold == fold) & ~np.isnan(self.y))
        true = self.y[rows] == 1
        sets = [self.sets[i] for i in rows]
        score = model.scores(np.concatenate(sets), np.cumsum([0, *map(len, sets)]))
        found = score >= T.THRESHOLD
        auc = (pd.Series(score).rank()[true].sum() - true.sum() * (true.sum() + 1) / 2) / (true.sum() * (~true).sum())
        sure = np.clip(np.where(true, score, 1 - score), 1e-6, 1)
        precision, recall = (found & true).sum() / max(1, found.sum()), (found & true).sum() / true.sum()
        return [auc, precision, recall, 2 * precision * recall / max(1e-9, precision + recall), -np.log(sure).mean()]


if __name__ == "__main__":
    corpus = Corpus(sys.argv[1])
    for T.LEAST_Z, T.LEAST_RATIO, decay in product((2, 3, 4), (1.5, 2, 4), (2e-5, 5e-5, 1e-4, 2e-4, 2e-3)):
        mean = np.mean([corpus.judged(corpus.model([f for f in FOLDS if f != own], decay), own) for own in FOLDS], axis=0)
        print(T.LEAST_Z, T.LEAST_RATIO, decay, *np.round(mean, 4), flush=True)
