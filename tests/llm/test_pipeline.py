"""The pipeline's stages over a small corpus, and run() against plain Python."""

import base64
import itertools
import random
import re

import pytest

pytest.importorskip("patternmill.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        kept[name] = docs.count()
        if name != "tokens":
            assert docs.columns == columns
    counts = list(kept.values())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0
    from patternmill.llm import minhash, tiling

    reread = spark.read.parquet(str(tmp_path / "benchmark"))
    assert tiling.leaks(reread, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).count() == 0
    assert minhash.near_duplicates(reread).filter("not kept").count() == 0
    assert docs.columns[:2] == ["doc_id", "n_tokens"] and docs.filter("size(ids) <> n_tokens").count() == 0


def _plain_language(model, text):
    import numpy as np

    words = re.findall(r"[^\W\d_]+", (text or "").lower())
    if not words:
        return False
    table = model.vectors.astype(float) @ model.out
    x = (np.mean([table[model.subwords([w])[0]].mean(0) for w in words], 0) + model.bias) / model.temperature
    p = np.exp(x - x.max())
    return p.max() / p.sum() >= model.threshold(len(words))


def _plain_near(rows):
    sets = []
    for _, t in rows:
        w = t.encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)})
    group = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
            a, b = group[i], group[j]
            group = [a if g == b else g for g in group]
    first = {}
    for g, row in sorted(zip(group, rows, strict=True), key=lambda x: x[1]):
        first.setdefault(g, row)
    return sorted(first.values())


def _plain_leak(item, text):
    a, b = (re.findall(r"[^\x00-/:-@\[-`{-\x7f\s]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) for t in (item, text))
    covered = 0
    while True:
        n, i, j = 0, 0, 0
        for x in range(len(a)):
            for y in range(len(b)):
                k = 0
                while x + k < len(a) and y + k < len(b) and a[x + k] == b[y + k]:
                    k += 1
                if k > n:
                    n, i, j = k, x, y
        if n < min(5, len(a)):
            return covered >= 0.5 * len(a)
        covered += n
        # Marked words equal nothing.
        a[i : i + n], b[j : j + n] = [None] * n, [0] * n


def test_run_is_what_plain_stages_give(spark, tmp_path):
    """run() against set Jaccard, greedy tiling, patterns and tiktoken in plain Python, row by row."""
    import public_tokenizers
    import tiktoken
    from patternmill.llm import langid

    rng = random.Random(21)
    sounds = {"aa": ["ka", "mo", "tu", "ri", "sel"], "bb": ["sch", "enf", "olt", "ung", "ae"]}

    def prose(lang, n):
        # One word in ten is of both languages.
        return " ".join("".join(rng.choices(sounds[lang] if rng.random() < 0.9 else ["la", "den", "ro"], k=rng.randint(2, 4))) for _ in range(n))

    items = [prose("aa", 20), prose("bb", 15), "Zibelquo"]
    secret = "0a1b2c3d4e5f60718293a4b5c6d7e8f9"
    texts = [(lang, prose(lang, rng.randint(20, 60))) for lang in ("aa", "bb") for _ in range(400)]
    clean = len(texts)
    long = prose("aa", 80).split()
    near, far = [w if k != 40 else "kaka" for k, w in enumerate(long)], [w if k % 9 else "kaka" for k, w in enumerate(long)]
    texts += [("aa", " ".join(x)) for x in (long, long, near, far)]
    words = items[0].split()
    texts += [("aa", f"{prose('aa', 9)} {t} {prose('aa', 9)}") for t in (items[0].upper(), " ".join(words[10:] + words[:10]), " ".join(words[:8]), "zibelquo!")]
    texts += [("bb", items[1])]
    texts += [("bb", f"{prose('bb', 12)} {t} {prose('bb', 12)}") for t in ("a.b@c.de", "10.0.0.1", "+1 (555) 555-0100", "4111 1111 1111 1111", "4111 1111 1111 1112")]
    texts += [("aa", f'Mrs. Vida Sol came; token = "{secret}" ok. {prose("aa", 20)}')]
    texts += [("aa", None), ("aa", ""), ("bb", "12 34 !"), (None, "привет лошадь вечер " * 9), (None, prose("bb", 10))]
    rows = [(i, t, lang, "s", len(t or "")) for i, (lang, t) in enumerate(texts)]
    rng.shuffle(rows)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    model = langid.train(spark.read.parquet(str(tmp_path / "documents.parquet")))
    known = sorted((i, t) for i, t, *_ in rows if _plain_language(model, t))
    apart = _plain_near(known)
    unseen = [(i, t) for i, t in apart if not any(_plain_leak(item, t) for item in items)]
    kinds = {r"a\.b@c\.de": "email", r"10\.0\.0\.1": "ip", r"\+1 \(555\) 555-0100": "phone", "4111 1111 1111 1111": "card", "Vida Sol": "person", secret: "secret"}
    hidden = [(i, re.sub("|".join(kinds), lambda m: next(f"<{k}>" for p, k in kinds.items() if re.fullmatch(p, m[0])), t)) for i, t in unseen]
    assert [len(rows) - len(known), len(known) - len(apart), len(apart) - len(unseen), sum(x != y for x, y in zip(unseen, hidden, strict=True))] == [4, 2, 4, 5]
    assert sum(i < clean for i, _ in hidden) == clean

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = sorted((r["doc_id"], r["n_tokens"], list(r["ids"])) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == [(i, len(ids), ids) for i, ids in ((i, plain.encode_ordinary(t)) for i, t in hidden)]


def test_near_duplicates_fill_no_driver(spark, sf_dir):
    """The stage ends though any table that is broadcast fails its query."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    spark.conf.set("spark.sql.maxBroadcastTableSize", "1b")
    try:
        kept = corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir).count()
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
    assert 0 < kept < docs.count()
