import random
import re
from collections import Counter

import numpy as np
from helpers import awkward, documents, rows

from tickloom.llm import line_crf, quality_rules


def brute(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    lines, dups = text.split("\n"), 0
    for i, line in enumerate(lines):
        dups += bool(re.search(r"[^\x20\x09-\x0D]", line)) and line in lines[:i]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(covered)


def test_statistics_match_brute_force():
    random.seed(2)
    for _ in range(300):
        text = "".join(random.choice(["a ", "b ", "a b c d e ", "é\t", "\n", "same line\n", "# ", "<|> "]) for _ in range(random.randint(0, 30)))
        assert quality_rules.statistics(text.encode())[:5] == brute(text)


def test_base_columns_equal_sql(spark):
    import duckdb

    path = "/root/testdata/sf0.001/documents.parquet"
    words = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
    sql = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {words} AS w FROM '{path}'),
    l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM d),
    dup AS (SELECT doc_id, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY k) AS nth FROM l) WHERE nth > 1 AND regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
    g AS (SELECT doc_id, k, array_to_string(w[k:k + 4], ' ') AS five FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 3))) AS k FROM d)),
    twice AS (SELECT doc_id, k FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, five) AS m FROM g) WHERE m > 1),
    rep AS (SELECT doc_id, count(DISTINCT k + j) AS n FROM twice, (SELECT unnest(range(0, 5)) AS j) GROUP BY doc_id)
    SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
           coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id)"""
    want = {r[0]: tuple(map(int, r[1:])) for r in duckdb.sql(sql).fetchall()}
    got = {r["doc_id"]: tuple(r[c] for c in quality_rules.COUNTS[:5]) for r in quality_rules.text_statistics(spark.read.parquet(path)).collect()}
    assert got == want


def test_window_codes_do_not_overflow():
    words = [str(i).encode() for i in range(9000)] * 2
    assert quality_rules.repeated_words(words) == 18000


def test_rules_are_learned_and_apply_in_order(spark):
    random.seed(1)
    good = ["plain words follow one another in number %d and so on they go without end" % i for i in range(60)]
    bad = ["".join(f"word{i}{k}### " for k in range(14)) for i in range(30)]
    docs = documents(spark, good + bad)
    labels = spark.createDataFrame([(i, int(i < 60), 0) for i in range(90)] + [(1, None, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    got = rows(quality_rules.quality_rules(docs, labels))
    assert len(got) == 90 and all(r["kept"] == (r["doc_id"] < 60) for r in got)
    kept = quality_rules.keep_good(docs, quality_rules.fit_rules(docs, labels))
    assert kept.columns == docs.columns and kept.count() == 60


def test_rules_of_awkward_rows(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = rows(quality_rules.quality_rules(awkward(spark), labels))
    assert len(got) == 10
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert r["kept"] == (not r["base_failed"])
    assert quality_rules.quality_rules(documents(spark, []), labels).count() == 0


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    counts = np.array([3, 1, 4])
    node, steps = rng.normal(size=8), rng.normal(size=(2, 2))
    got, pairs, log_z = line_crf.marginals(node, counts, steps)
    want, want_pairs, total, at = [], np.zeros((2, 2)), 0.0, 0
    for n in counts:
        weights, paths = [], []
        for code in range(2**n):
            y = [code >> k & 1 for k in range(n)]
            weights.append(np.exp(sum(node[at + k] * y[k] for k in range(n)) + sum(steps[y[k], y[k + 1]] for k in range(n - 1))))
            paths.append(y)
        weights = np.array(weights)
        total += np.log(weights.sum())
        p = weights / weights.sum()
        want += [sum(p[i] for i in range(len(p)) if paths[i][k]) for k in range(n)]
        for i, y in enumerate(paths):
            for k in range(n - 1):
                want_pairs[y[k], y[k + 1]] += p[i]
        at += n
    assert np.allclose(got[:, 1], want) and np.allclose(pairs, want_pairs) and np.isclose(log_z, total)


def test_line_field_separates_held_out_documents(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = line_crf.line_quality(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (got["predicted"] == got["quality"]).mean() > 0.95
    assert got["score"].between(0, 1).all()


def test_line_field_of_awkward_rows(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = rows(line_crf.line_quality(awkward(spark), labels))
    assert len(got) == 10 and all(r["score"] == 0.5 for r in got)
    model = line_crf.fit([line_crf.line_features(t)[0] for t in (b"fine text here.", b"### ### ###") * 5], [np.array([15.0]), np.array([11.0])] * 5, np.array([1, 0] * 5))
    got = rows(line_crf.score(awkward(spark), model))
    assert len(got) == 10 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert line_crf.keep_good(documents(spark, []), model).count() == 0
