"""The pipeline against brute force, stage by stage, and without the subpackage."""

import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
from test_decontaminate import brute as contamination
from test_ngram_join import brute as near
from tokenizers import Tokenizer

import corpus_pipeline
from stackline.llm import quality_rules, secret_scan
from stackline.llm.queries import TOKENIZER

ROOT = Path(__file__).resolve().parents[2]


def test_stages_match_brute_force(spark, make, prose, tmp_path):
    base = prose(200, 1)
    items = [(1, prose(30, 900)), (2, prose(20, 901))]
    texts = [None, "", prose(20, 2), base, base, base.replace(base.split()[100], "changed", 1), prose(120, 3) + " password=hunter22 " + prose(50, 4), prose(60, 5) + " " + items[0][1], prose(70, 6), "#a " * 80, *[prose(80 + 9 * k, 10 + k) for k in range(20)]]
    rows = list(enumerate(texts))
    docs = make(rows, "kept")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    good = [(i, t) for i, t in rows if quality_rules.passes(quality_rules.figures(t), list(quality_rules.RULES))]
    one = {i for i, _, c in near(good) if i == c}
    clean = [(i, t) for i, t in good if i in one and not contamination(t, items)[4]]
    encode = Tokenizer.from_file(TOKENIZER)
    want = set()
    for i, t in clean:
        ids = np.array([*encode.encode(secret_scan.redacted(t), add_special_tokens=False).ids, 0], "<u4")
        want.add((i, len(ids), zlib.crc32(ids.tobytes())))
    assert 0 < len(clean) < len(good) < len(rows) and 7 not in dict(clean) and {3, 4, 5} & one == {3}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {(r["doc_id"], r["length"], r["ids_crc32"]) for r in out} == want and len(out) == len(want)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "benchmark decontamination", "secret scans", "best-fit packing"]
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns


def test_the_rest_imports_without_it(tmp_path):
    for name in ("__spark_entry__.py", "stackline"):
        (tmp_path / name).symlink_to(ROOT / name) if name.endswith(".py") else None
    rest = tmp_path / "stackline"
    rest.mkdir()
    for p in (ROOT / "stackline").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (rest / p.name).symlink_to(p)
    said = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; print(len(e.queries()), [n for n in e.queries() if n.startswith('op') or n == 'pipeline'], len(e.oracle_sql()) > 0)"], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path), "HOME": str(tmp_path)}, capture_output=True, text=True)
    assert "[] True" in said.stdout, said.stderr
