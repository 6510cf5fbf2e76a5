"""An index read in splits gives what one task reads, wherever the borders fall."""

import json
import random

import pytest

from atomweave.sources import index


def made(rng, n):
    word = lambda: "".join(rng.choice(['a', '{', '}', '[', ']', '"', "\\", ",", ":", "é", "\n", ' {"relative_path": "x"} ']) for _ in range(rng.randint(0, 12)))
    symbol = lambda: {"symbol": word(), "kind": rng.choice([6, 17]), "display_name": rng.choice([None, word()]), "documentation": [word()], "signature_documentation": {"language": "rust", "text": word(), "position_encoding": 0}}
    docs = [{"language": "rust", "relative_path": f"/src/{i}{word()}.rs", "occurrences": [{"range": [i, 0, 4], "symbol": word(), **({"symbol_roles": 1} if rng.random() < 0.5 else {})} for _ in range(rng.randint(0, 4))], "symbols": [symbol() for _ in range(rng.randint(0, 3))], "position_encoding": 0} for i in range(n)]
    return {"metadata": {"tool_info": {"name": word(), "version": "1"}, "project_root": word(), "text_document_encoding": 0}, "documents": docs, "external_symbols": [symbol() for _ in range(3)]}


@pytest.mark.parametrize(("split", "indent"), [(97, None), (1 << 20, 2)])
def test_split_index(spark, tmp_path, split, indent):
    rng = random.Random(split)
    for i, n in enumerate((25, 1, 0)):
        (tmp_path / f"i{i}.json").write_text(json.dumps(made(rng, n), indent=indent, ensure_ascii=i == 0))
    plain = [sorted(map(str, df.collect())) for df in index.read_index(spark, str(tmp_path))]
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = [sorted(map(str, df.collect())) for df in index.read_index(spark, str(tmp_path), split=True)]
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert got == plain and all(plain)
