"""Re-exports are followed key by key, not request by request."""

from skein.operators import exports


def test_keys_are_followed_once(spark, monkeypatch):
    sizes, cut = [], exports.cut
    monkeypatch.setattr(exports, "cut", lambda df: sizes.append(cut(df)) or sizes[-1])
    modules = [f"m{k:02}" for k in range(24)]
    stars = spark.createDataFrame([*zip(modules, modules[1:], strict=False), (modules[-1], modules[0])], "module string, to_module string")
    declared = spark.createDataFrame([("m23", "f", "id:f")], "module string, name string, id string")
    aliases = spark.createDataFrame([("m05", "g", "m04", "f")], "module string, name string, to_module string, to_name string")
    requests = spark.createDataFrame([(m, n) for m in modules for n in "fg"], "module string, name string")
    got = {(r["module"], r["name"]): (r["node_id"], r["n"]) for r in exports.resolved(requests, declared, aliases, stars).collect()}
    # The circle of modules has an alias for g on it, which leads to the f of another module.
    assert got == {(m, n): ("id:f", 1) for m in modules for n in "fg"}
    assert max(df.count() for df in sizes) <= 2 * len(requests.collect())
