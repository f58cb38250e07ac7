import numpy as np
from pyspark.sql import functions as F

from tabwise.operators import mlp as MLP


def test_gradient_matches_finite_differences():
    rng = np.random.default_rng(0)
    shapes = MLP.layer_shapes(4, (3, 4))
    theta = MLP.init_params(shapes, "tanh", 1)
    x, y = rng.normal(size=(20, 4)), (rng.random(20) > 0.5).astype(float)
    for act in ("relu", "tanh", "logistic", "identity"):
        _, g = MLP.loss_and_grad(theta, shapes, act, 1e-2, x, y)
        num = np.zeros_like(theta)
        for i in range(len(theta)):
            e = np.zeros_like(theta)
            e[i] = 1e-6
            num[i] = (MLP.loss_and_grad(theta + e, shapes, act, 1e-2, x, y)[0]
                      - MLP.loss_and_grad(theta - e, shapes, act, 1e-2, x, y)[0]) / 2e-6
        assert np.allclose(g, num, atol=1e-6), act


def test_spark_forward_matches_numpy(spark):
    rng = np.random.default_rng(1)
    model = MLP.MLPModel(MLP.init_params(MLP.layer_shapes(3, (3, 4)), "relu", 2).tolist(), 3, (3, 4), "relu")
    x = rng.normal(size=(25, 3))
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id int, x array<double>")
    got = [r.probability for r in MLP.predict_mlp(df, model, "x").orderBy("id").collect()]
    want = MLP.forward(np.array(model.theta), model.shapes, "relu", x)[-1][:, 0]
    assert np.allclose(got, want, atol=1e-12)


def test_mlp_learns_a_separable_problem(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(0, 1, size=(600, 2))
    y = (x[:, 0] + x[:, 1] > 1.0).astype(int)
    df = spark.createDataFrame([(i, [float(a), float(b)], int(t)) for i, ((a, b), t) in enumerate(zip(x, y))],
                               "id long, x array<double>, label int").repartition(2)
    model = MLP.fit_mlp(df, "x", "label", hidden=(8,), activation="tanh", batch_size=50,
                        learning_rate=0.05, max_iter=60, seed=1)
    acc = (MLP.predict_mlp(df, model, "x").agg(F.avg((F.col("prediction") == F.col("label")).cast("double")))
           .first()[0])
    assert acc >= 0.9
    assert model.loss_curve[-1] < model.loss_curve[0]
    assert MLP.loss_table(spark, model).count() == len(model.loss_curve)
    assert [r.units for r in model.layer_table(spark).orderBy("layer").collect()] == [2, 8, 1]


def test_early_stopping_uses_validation_scores(spark):
    rng = np.random.default_rng(4)
    x = rng.uniform(0, 1, size=(300, 2))
    y = (x[:, 0] > 0.5).astype(int)
    df = spark.createDataFrame([(i, [float(a), float(b)], int(t)) for i, ((a, b), t) in enumerate(zip(x, y))],
                               "id long, x array<double>, label int")
    model = MLP.fit_mlp(df, "x", "label", hidden=(4,), activation="relu", learning_rate=0.05, max_iter=40,
                        early_stopping=True, id_col="id", seed=2)
    assert len(model.validation_scores) == len(model.loss_curve) > 0


def test_training_does_not_depend_on_partitions(spark):
    rng = np.random.default_rng(5)
    x = rng.uniform(0, 1, size=(700, 2))
    df = spark.createDataFrame([(i, [float(a), float(b)], int(a > b)) for i, (a, b) in enumerate(x)],
                               "id long, x array<double>, label int")
    for slices in (1, 3):
        fits = [MLP.fit_mlp(df.repartition(n), "x", "label", hidden=(4,), batch_size=8, learning_rate=0.02, max_iter=4,
                            id_col="id", seed=3, slices=slices) for n in (1, 4, 30)]
        for other in fits[1:]:
            assert np.allclose(fits[0].loss_curve, other.loss_curve, rtol=1e-9)
            assert np.allclose(fits[0].theta, other.theta, atol=1e-9)


def test_gradient_sums_are_those_of_all_rows(spark):
    """Every partition adds its rows; the job's sums are NumPy's over the whole table."""
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(333, 3)), rng.integers(0, 2, 333)
    df = spark.createDataFrame([([float(v) for v in a], float(b)) for a, b in zip(x, y)], "_x array<double>, _y double").repartition(13)
    shapes = MLP.layer_shapes(3, (4, 2))
    theta = MLP.init_params(shapes, "tanh", 3)
    loss, grad, n = MLP.gradient_sums(df, theta, shapes, "tanh")
    want_loss, want_grad = MLP.loss_and_grad_sums(theta, shapes, "tanh", x, y.astype(float))
    assert n == 333 and np.isclose(loss, want_loss) and np.allclose(grad, want_grad)
