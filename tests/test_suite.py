from tidelog.plans import catalog


def test_without_adaptive_mass_the_suite_reproduces_its_anchor(spark, sf):
    rows = catalog.QUERIES["calibration_suite"](spark, sf).collect()
    loss = {(r["method"], r["day"]): r["loss"] for r in rows}
    days = {d for m, d in loss if m == "ops"}
    assert days and all(loss["anchor_only", d] == loss["ops", d] for d in days)
    assert all(loss["anchor_only_flat", d] == loss["ops_flat", d] for d in days)


def test_hashed_vectors_have_one_entry_per_token(spark, sf):
    rows = catalog.QUERIES["hash_features"](spark, sf).collect()
    assert rows and all(1 <= len(r["positions"]) <= 3 for r in rows)
