"""The hazard model against a plain Newton fit on the same small panel."""

import numpy as np
import pandas as pd
import pytest

from usagelens.operators import customers


def newton_logit(x, y, steps=60):
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ beta))
        information = x.T @ (x * (p * (1 - p))[:, None])
        beta = beta + np.linalg.solve(information, x.T @ (y - p))
    return beta, np.sqrt(np.diag(np.linalg.inv(information)))


def test_coefficients_and_intervals_match_newton(tables):
    panel = customers.survival_panel(tables.customer_months, tables.customers, tables.runs).persist()
    got = {r["feature"]: r for r in customers.hazard_odds_ratios(panel).collect()}
    local = panel.select("churned_event", *customers.HAZARD_CATEGORIES, *customers.HAZARD_NUMBERS).toPandas()
    dummies = pd.get_dummies(
        local[customers.HAZARD_CATEGORIES + customers.HAZARD_NUMBERS],
        columns=customers.HAZARD_CATEGORIES,
        drop_first=True,
    ).astype(float)
    dummies = dummies.loc[:, dummies.nunique() > 1]
    assert set(got) == set(dummies.columns)
    x = np.column_stack([np.ones(len(dummies)), dummies.to_numpy()])
    beta, se = newton_logit(x, local["churned_event"].to_numpy(dtype=float))
    for name, b, s in zip(dummies.columns, beta[1:], se[1:]):
        assert got[name]["coef"] == pytest.approx(b, rel=1e-4, abs=1e-6), name
        assert got[name]["odds_ratio_ci_low"] == pytest.approx(np.exp(b - 1.959964 * s), rel=1e-3), name
        assert got[name]["odds_ratio_ci_high"] == pytest.approx(np.exp(b + 1.959964 * s), rel=1e-3), name


def test_holdout_keeps_each_customer_on_one_side(tables):
    ids = tables.customers.select("customer_id")
    held = ids.where(customers.in_holdout()).count()
    assert held + ids.where(~customers.in_holdout()).count() == ids.count()
    assert 0.1 < held / ids.count() < 0.4


def test_equal_rows_enter_the_fit_once(spark, monkeypatch):
    from itertools import product

    import numpy as np

    from usagelens.operators import customers

    cells = list(product([0, 1], ["Organic", "Referral"], ["Pro", "Team"], [0.0, 1.0], [1, 3]))
    rows, x, y = [], [], []
    for i, (event, channel, plan, score, tenure) in enumerate(cells):
        for k in range(4 + (i * 7) % 5 + 3 * event * (plan == "Team")):
            rows.append((f"c{i}-{k}", event, channel, plan, score, tenure, tenure**2 % 5, 0.0, 0.0, 0.5 * (i % 3)))
            x.append([1.0, score, tenure, tenure**2 % 5, 0.5 * (i % 3), float(channel == "Referral"), float(plan == "Team")])
            y.append(event)
    names = ["customer_id", "churned_event", *customers.HAZARD_CATEGORIES, *customers.HAZARD_NUMBERS]
    # tenure_months_sq is collinear with two tenures only, so it is left constant here
    rows = [(*r[:6], 1, *r[7:]) for r in rows]
    x = np.delete(np.array(x), 3, axis=1)
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ beta))
        beta = beta + np.linalg.solve((x.T * (p * (1 - p))) @ x, x.T @ (np.array(y) - p))
    fitted = []
    whole = customers.GeneralizedLinearRegression.fit
    monkeypatch.setattr(customers.GeneralizedLinearRegression, "fit", lambda self, data: fitted.append(data.count()) or whole(self, data))
    got = {r.feature: r.coef for r in customers.hazard_odds_ratios(spark.createDataFrame(rows, names)).collect()}
    want = dict(zip(["activation_score", "tenure_months", "log_monthly_runs", "acquisition_channel_Referral", "plan_Team"], beta[1:]))
    assert fitted[0] <= len(cells) < len(rows)
    assert got.keys() == want.keys() and all(abs(got[c] - want[c]) < 1e-8 for c in want)
