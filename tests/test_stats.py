import math

from cairnflow.functions import stats as S


def test_t_quantile():
    for df, want in ((1, 12.7062), (2, 4.3027), (4, 2.7764), (30, 2.0423)):
        assert abs(S.t_quantile(0.975, df) - want) < 1e-3
    assert abs(S.t_quantile(0.025, 4) + S.t_quantile(0.975, 4)) < 1e-12


def test_ks_pvalue():
    # two samples of three, wholly apart: two of the twenty orders
    assert abs(S.ks_pvalue(1.0, 3, 3) - 0.1) < 1e-12
    assert S.ks_pvalue(0.0, 5, 5) == 1.0
    big = S.ks_pvalue(0.05, 20000, 20000)
    lam = 0.05 * math.sqrt(10000)
    assert abs(big - 2 * math.exp(-2 * lam * lam)) < 1e-6
    assert abs(S.ks_pvalue(0.12, 500, 500) - 0.00149) < 4e-4


def test_sql_functions(spark):
    S.register(spark)
    r = spark.sql("select t_quantile(0.975, 4) as t, ks_pvalue(1.0, 3, 3) as p, ks_pvalue(null, 3, 3) as n").first()
    assert abs(r["t"] - 2.7764) < 1e-3 and abs(r["p"] - 0.1) < 1e-9 and r["n"] is None
