import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))


@pytest.fixture
def frame(spark):
    """Rows (doc_id, text) as a table that also has columns with names the operators use inside."""

    def make(rows, extra=True):
        table = spark.createDataFrame(rows, "doc_id long, text string")
        clash = ["row", "node", "words", "lang", "line_dedup", "quality_rules", "slot", "shard", "h", "at", "_id"]
        return table.selectExpr("*", *(f"'x' AS {c}" for c in clash)) if extra else table

    return make


@pytest.fixture
def corpus():
    """Texts with copies, near copies, shared passages and lines, nulls and blanks."""

    def make(n, seed=1, vocabulary=400):
        r = random.Random(seed)
        v = ["".join(r.choice("abcdeéß") for _ in range(r.randint(1, 7))) for _ in range(vocabulary)]
        text = lambda k: " ".join(r.choice(v) for _ in range(k))
        passages, rows = [text(90) for _ in range(4)], [(0, None), (1, ""), (2, " \t\n "), (3, "one two"), (4, "One TWO"), (5, text(1200))]
        for k in range(len(rows), n):
            kind, old = r.random(), r.choice(rows)[1] or ""
            if kind < 0.3:
                new = text(r.randint(1, 160))
            elif kind < 0.5:
                new = text(r.randint(0, 30)) + "\n" + r.choice(passages) + "\n" + text(r.randint(0, 30))
            elif kind < 0.8:
                w = old.split(" ")
                for _ in range(r.randint(0, 3)):
                    w[r.randrange(len(w))] = r.choice(v)
                new = " ".join(w)
            elif kind < 0.9:
                new = old
            else:
                new = old.upper() + " " + text(r.randint(0, 5))
            rows.append((k, new))
        return rows

    return make
