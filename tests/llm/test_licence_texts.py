"""Whole licence texts and notices of several lines are told apart."""

import pytest

licenses = pytest.importorskip("rankloom.llm.licenses")


def test_whole_texts_and_header_blocks(spark):
    kinds = licenses.full_texts()
    files = [(f"{n}/{i}/LICENSE", f"Some project, by A. Person, 2021\n\n{t}", n) for n, ts in kinds["text"].items() for i, t in enumerate(ts)]
    for n, ts in kinds["notice"].items():
        for i, t in enumerate(ts):
            body = "\n".join(f" * {x.strip()}" for x in t.splitlines())
            files.append((f"src/{n}-{i}.c", f"/* Copyright (C) 2021 A. Person\n{body}\n */\n\nint main() {{ return 0; }}\n", n))
    files.append(("prose/a.txt", "A long walk\nunder a licence of nobody\nended at the river", None))
    df = spark.createDataFrame(files, "path string, text string, want string")
    got = {r.path: r for r in licenses.scan(df).collect()}
    assert {p: got[p].license for p, _, _ in files} == {p: w for p, _, w in files}
    assert all(got[p].origin == "own" for p, _, w in files if w)
