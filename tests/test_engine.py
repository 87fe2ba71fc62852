import numpy as np
import pytest
from pyspark.sql import functions as F

from veilstat.functions import fixed, vectors as V
from veilstat.operators import basis, metrics, ortho, stats, sweep
from veilstat.operators.lloyd import federated_lloyd, fold, initial_centroids
from veilstat.params import Params
from veilstat.sources import points as P


def frame(spark, x, clients=1):
    return spark.createDataFrame([(i, i % clients, [float(v) for v in r]) for i, r in enumerate(x)], "point_id long, client_id int, features array<double>")


def test_scalars(spark):
    df = spark.createDataFrame([(v,) for v in (1.5, -1.5, 3.2, 5.0)], "x double")
    assert [round(r[0], 9) for r in df.select(V.fold(F.col("x"))).collect()] == [0.5, -0.5, -0.8, 1.0]
    assert np.allclose(fold(np.array([1.5, -1.5, 3.2, 5.0])), [0.5, -0.5, -0.8, 1.0])
    assert [r[0] for r in df.select(fixed.to_fixed(F.col("x"))).collect()] == [98304, -98304, 209715, 327680]
    with pytest.raises(TypeError):
        V.truncate(F.col("x"), "a", 1)
    with pytest.raises(ValueError):
        V.fold(F.col("x"), 1, 1)


def test_normalise(spark):
    got = P.normalize(frame(spark, [[1, 2, 7], [3, 4, 7]]), 3).orderBy("point_id").collect()
    assert [r.features for r in got] == [[-1, -1, 0], [1, 1, 0]]


def test_text_round_trip(spark, tmp_path):
    P.save_dataset(frame(spark, [[0.5, -1.25], [3, 4]]), str(tmp_path / "p"))
    (tmp_path / "p" / "header.txt").write_text("x y\n")
    assert sorted(r.features for r in P.load_txt(spark, str(tmp_path / "p")).collect()) == [[0.5, -1.25], [3, 4]]


def test_split(spark):
    df = frame(spark, np.zeros((101, 1)))
    got = [r["count"] for r in P.shuffle_and_split(df, [2, 1, 1], 3).groupBy("client_id").count().orderBy("client_id").collect()]
    assert got == P.client_sizes(101, [2, 1, 1]) == [50, 25, 26]


def lloyd(x, clients, c, iters):
    """Plain NumPy, with phantoms."""
    for _ in range(iters):
        label = ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
        s, n = np.zeros_like(c), np.zeros(len(c))
        for j in np.unique(clients):
            for k in range(len(c)):
                m = (label == k) & (clients == j)
                s[k] += np.trunc(x[m] * 65536).sum(axis=0) / 65536 if m.any() else np.trunc(c[k] * 65536) / 65536
                n[k] += max(1, m.sum())
        c = s / (n[:, None] + 1e-9)
    return c


def test_lloyd(spark):
    x = np.random.RandomState(7).uniform(-1, 1, (300, 4))
    p = Params(k=4, dim=4, data_size=300, seed=3)
    df = frame(spark, x, 2)
    got = federated_lloyd(df, p)
    want = lloyd(x, np.arange(300) % 2, initial_centroids(p), 7)
    assert np.abs(got.centroids - want).max() < 2e-5
    assert (got.centroids_fixed == federated_lloyd(df, p, use_masks=False, kernel="sql").centroids_fixed).all()
    assert len(got.history) == 7


def test_private_runs_end(spark):
    df = frame(spark, np.random.RandomState(1).uniform(-1, 1, (200, 2)), 2)
    for dp, method, post in (("laplace", "none", "truncate"), ("gaussiananalytic", "diagonal_then_frac", "fold"), ("gaussiananalytic", "stay_frac", "fold_unclipped")):
        got = federated_lloyd(df, Params(k=2, dim=2, data_size=200, dp=dp, eps=1.0, method=method, post=post, alpha=0.8))
        assert np.abs(got.centroids).max() <= 1 and np.isfinite(got.centroids).all()


def test_bases(spark):
    q = basis.random_orthogonal_basis(4, 2, 42)
    want = np.array([[-0.115389, 0.463167], [-0.6602, -0.690953], [0.143969, 0.009207], [-0.728075, 0.554954]])
    assert np.allclose(np.abs(q), np.abs(want), atol=1e-5) and np.allclose(q.T @ q, np.eye(2), atol=1e-10)
    rng = np.random.RandomState(0)
    x = np.stack([20 * rng.randn(400), *(0.1 * rng.randn(7, 400))], axis=1)
    df = frame(spark, x)
    assert abs(basis.svd_pca_basis(df, 8, 1)[0, 0]) > 0.999
    w = basis.dpsgd_pca_basis(df, 8, 3, 3.0, 1e-5, 1.0, 1.0)
    assert w.shape == (8, 3) and np.allclose(w.T @ w, np.eye(3), atol=1e-10)
    with pytest.raises(ValueError):
        basis.orthogonal_basis(df, 8, 2, "x")
    with pytest.raises(KeyError):
        basis.orthogonal_basis(df, 8, 2, "dpsgd_pca")


def test_ortho(spark):
    q = basis.random_orthogonal_basis(4, 2, 42)
    corners = [q @ s for s in ([1, 1], [1, -1], [-1, 1], [-1, -1])]
    got = ortho.ortho_assign(frame(spark, corners), q).orderBy("point_id").collect()
    assert [r.label for r in got] == [3, 1, 2, 0]
    res = ortho.ortho_cluster(frame(spark, np.ones((100, 3))), Params(k=1, dim=3, data_size=100, d_prime=2, basis_method="random"))
    assert len(res.labels) == 1 and res.stats["count_max"] == 100


def test_metrics(spark):
    x = np.concatenate([np.random.RandomState(2).randn(20, 2), np.random.RandomState(3).randn(20, 2) + 8])
    c = [[0.0, 0.0], [8.0, 8.0], [99.0, 99.0]]
    got = metrics.evaluate(frame(spark, x), c, "all", truth=c)
    d2 = ((x[:, None] - np.array(c)[None]) ** 2).sum(axis=2).min(axis=1)
    assert got[metrics.NAMES["nicv"]] == pytest.approx(d2.mean()) and got[metrics.NAMES["empty_clusters"]] == 1 and got[metrics.NAMES["mse"]] == 0
    assert 0.6 < got[metrics.NAMES["silhouette"]] <= 1 and got[metrics.NAMES["dunn_index"]] > 0.5
    one = metrics.evaluate(frame(spark, x), [[0.0, 0.0]], ["silhouette", "davies_bouldin", "calinski_harabasz", "dunn_index", "nothing"])
    assert one[metrics.NAMES["silhouette"]] == -1 and one[metrics.NAMES["davies_bouldin"]] == float("inf") and one[metrics.NAMES["calinski_harabasz"]] == 0 and np.isnan(one[metrics.NAMES["dunn_index"]])


def test_masks(spark):
    df = spark.createDataFrame([(c, k, 5 + c, -7 * k) for c in range(3) for k in range(2)], "client_id int, cluster int, n long, s0 long")
    clients = df.select("client_id").distinct()
    got = stats.unmask(stats.secure_sum(stats.masked(df, 1, 9, 1), 1), stats.mask_sums(clients, 2, 1, 9, 1), 1)
    assert sorted(map(tuple, got.collect())) == [(0, 18, 0), (1, 18, -21)]


def test_sweep(spark):
    rows, failures = sweep.run_grid(P.normalize(frame(spark, np.random.RandomState(0).randn(120, 2)), 2), "toy", Params(k=2, dim=2, data_size=120), [{"dp": "none"}, {"dp": "wrong"}], [0, 1])
    assert len(rows) == 2 and len(failures) == 2 and sweep.successes(rows) == 2
    assert len(list(sweep.grid(sweep.PRESETS["accuracy"]))) == 44


def test_pairwise_by_blocks(spark):
    """Pairs of blocks give what one block gives, and what NumPy does."""
    rng = np.random.RandomState(3)
    x, label = rng.uniform(-1, 1, (90, 3)), rng.randint(0, 4, 90)
    df = spark.createDataFrame([([float(v) for v in r], int(c)) for r, c in zip(x, label)], "features array<double>, cluster int")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    s = []
    for i in range(90):
        mean = {c: d[i, label == c].sum() / ((label == c).sum() - (c == label[i])) for c in range(4)}
        a, b = mean[label[i]], min(v for c, v in mean.items() if c != label[i])
        s.append((b - a) / max(a, b))
    same = label[:, None] == label[None]
    for rows in (16, 1000):
        assert metrics.silhouette(df, rows).first()[0] == pytest.approx(np.mean(s), abs=1e-12)
        assert metrics.dunn(df, rows).first()[0] == pytest.approx(d[~same].min() / d[same].max(), abs=1e-12)


def test_result_tree(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0.5), (2, 0.25)], "k int, nicv double")
    sweep.save_results(rows, str(tmp_path / "a"))
    sweep.save_results(rows, str(tmp_path / "b"), "ortho")
    got = sweep.load_results(spark, str(tmp_path)).collect()
    assert sorted((r.k, r.nicv) for r in got) == [(1, 0.5), (1, 0.5), (2, 0.25), (2, 0.25)] and len({r.file for r in got}) == 2
    sweep.save_failures(spark, [{"k": 1, "error": "x"}], str(tmp_path / "failed.json"))
    assert spark.read.json(str(tmp_path / "failed.json")).first().error == "x"


def test_private_basis_apart(spark):
    """Steps over distributed batches find the direction that steps on the driver find, and their gradient is NumPy's."""
    rng = np.random.RandomState(0)
    x = np.stack([20 * rng.randn(3000), *(0.1 * rng.randn(4, 3000))], axis=1)
    df = frame(spark, x)
    for rows in (100_000, 100):
        w = basis.dpsgd_pca_basis(df, 5, 2, 8.0, 1e-5, 1.0, 1.0, epochs=1, seed=1, driver_rows=rows, steps=8)
        assert w.shape == (5, 2) and np.allclose(w.T @ w, np.eye(2), atol=1e-10)
    q = basis.random_orthogonal_basis(5, 2, 3)
    mean = x.mean(axis=0)
    assert np.allclose(basis._summed_gradient(df, mean, q, 0.7), basis.clipped_gradient(x - mean, q, 0.7))
    one = -2 * np.outer(x[7] - mean, (x[7] - mean) @ q)
    assert np.allclose(basis.clipped_gradient((x - mean)[7:8], q, 0.7), one * min(1, 0.7 / (np.linalg.norm(one) + 1e-8)))


def test_seeded_order(spark, monkeypatch):
    """Cuts found by prefixes of one digit are those of a whole sort."""
    import hashlib

    monkeypatch.setattr(P, "EDGE_ROWS", 3)
    monkeypatch.setattr(P, "DIGITS", 1)
    df = frame(spark, np.zeros((200, 1))).drop("client_id")
    order = sorted(range(200), key=lambda i: (hashlib.md5(f"5:{i}".encode()).hexdigest(), i))
    for n in (0, 1, 77, 199, 200, 300):
        assert sorted(r.point_id for r in P.subsample(df, n, 5).collect()) == sorted(order[:n])
    got = {r.point_id: r.client_id for r in P.shuffle_and_split(df, [0, 1, 2, 0, 1], 5).collect()}
    assert [got[i] for i in order] == [1] * 50 + [2] * 100 + [4] * 50
    assert P.shuffle_and_split(df.limit(0), [1, 1], 5).count() == 0
    odd = df.withColumn("point_id", F.when(F.col("point_id") > 3, F.col("point_id")))
    assert sorted(r["count"] for r in P.shuffle_and_split(odd, [1, 1], 5).groupBy("client_id").count().collect()) in ([98, 102], [99, 101], [100, 100], [97, 103])


def test_scale_sets(spark):
    for k, n, o in ((2, 10, 0), (5, 1000, 0), (32, 10_000, 100)):
        sizes = P.proportional_sizes(n, k, o)
        assert len(sizes) == k and abs(sum(sizes) + o - n) <= k
    assert len(P.scale_names()) == 135
    a, b = (P.synthetic(spark, f"SynthNew_4_3_{r}") for r in (1, 2))
    count = lambda df: {r.label: r["count"] for r in df.groupBy("label").count().collect()}
    assert count(a) == count(b) and [r.features for r in a.limit(3).collect()] != [r.features for r in b.limit(3).collect()]
    assert count(P.scale_set(spark, 4, 3, outliers=7))[4] == 7


def test_basis_benchmark(spark):
    rows = ortho.basis_benchmark(frame(spark, np.random.RandomState(1).uniform(-1, 1, (60, 3))), 3, [1, 2], [0, 1, 2])
    assert [(r["d_prime"], r["seed"]) for r in rows] == [(d, s) for d in (1, 2) for s in (0, 1, 2)] and all(r["elapsed"] > 0 for r in rows)
    got = {r.d_prime: r for r in ortho.benchmark_summary(spark.createDataFrame(rows), 2).collect()}
    assert got[2].num_clusters == 4 and got[1].num_occupied == np.mean([r["num_occupied"] for r in rows if r["d_prime"] == 1 and r["seed"] > 0])


def test_command_line(spark, tmp_path):
    """A readable set's results and a missing one's failure."""
    from veilstat.__main__ import default_datasets, main

    assert len(default_datasets("timing")) == 10 and len(default_datasets("scale")) == 135 and default_datasets("accuracy")[0] == "iris"
    P.save_dataset(frame(spark, np.random.RandomState(0).randn(60, 2)).coalesce(1), str(tmp_path / "data" / "raw.txt"))
    (tmp_path / "data" / "raw.txt").rename(tmp_path / "data" / "Synth_2_2_1.txt")
    options = ["--exp_type", "test", "--num_runs", "1", "--method", "none", "--post", "none", "--data_folder", str(tmp_path / "data"), "--results_folder", str(tmp_path / "out")]
    assert main(["--datasets", "Synth_2_2_1", "Synth_2_2_9", *options]) == 1
    got = sweep.load_results(spark, str(tmp_path / "out" / "test")).collect()
    assert {r.dataset for r in got} == {"Synth_2_2_1"} and {r.dp for r in got} == {"none", "gaussiananalytic"}
    assert [r.dataset for r in spark.read.json(str(tmp_path / "out" / "failed.json")).collect()] == ["Synth_2_2_9"]
