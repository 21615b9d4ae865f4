import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from clausemill.llm import fim
from oracle import compare


def plain(text, doc_id, seed=7, rate=100, spm_rate=50):
    """The contract read literally, with a list of lines."""
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= rate:
        return len(lines), "plain", None, None, text
    a, b = sorted((h1 % (len(lines) + 1), h2 % (len(lines) + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if h4 % 100 < spm_rate:
        return len(lines), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(lines), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("block", [1, 2, 3, 7, 64, 4096])
def test_transform_against_lines(block):
    rng = random.Random(block)
    for k in range(300):
        text = "".join(rng.choice("ab\n\né世🎉<P>S\r ") for _ in range(rng.choice((0, 1, 2, 9, 60, 400))))
        found = fim.transform(text, k, block)
        assert found == plain(text, k)
        assert fim.restore(found[4], found[1]) == text
    assert fim.transform("x\n", 5, block, rate=0)[1] == "plain" and fim.transform("x\n", 5, block, spm_rate=0)[1] == "psm"


def test_every_cut_of_the_tree():
    text = "a\n\nbé\n" * 50 + "世 end"
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    for block in (1, 5, 8, 33, 1000):
        tree = fim.BlockTree(text.encode(), block)
        assert tree.units == len(lines) and tree.chars == len(text)
        for u in range(len(lines) + 1):
            head = "".join(lines[:u])
            assert tree.cut(u) == (len(head.encode()), len(head))


def test_marks_that_nearly_meet_the_text():
    for text in ("<", "<S", "<P\n<M\n<", "S>\nP>\n>", "<<\n<S\n<M\n", "<S\n>"):
        for k in range(40):
            _, form, _, _, output = fim.transform(text, k)
            assert fim.restore(output, form) == text


def test_odd_rows(spark, odd):
    rows = fim.restored(fim.transformed(odd.withColumn("OUTPUT", F.lit(1)))).collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert (r.n_units, r.form, r.prefix_chars, r.middle_chars, r.output) == plain(r.text, r.doc_id)
        assert r.restored == (r.text or "")
    assert fim.transformed(odd.limit(0)).count() == 0
    assert fim.transformed(odd).columns == [*odd.columns, "n_units", "form", "prefix_chars", "middle_chars", "output"]


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query(spark, sf):
    compare(spark, fim.op13_fill_in_middle, fim.ORACLES["op13_fill_in_middle"], f"/root/testdata/sf{sf}")
