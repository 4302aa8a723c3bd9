"""Dependencies found in code against declared relations."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.functions import imports
from attestry.functions.paths import parent_path, path_prefixes
from attestry.functions.text import sha256_text
from attestry.operators.keyed import cut_lineage, salted_join, shuffled_join
from attestry.operators.predicates import detect_language
from attestry.operators.reach import STRUCTURAL

# Relation types in their canonical order.
RELATION_TYPES = ["uses", "calls", "extends", "implements", "emits", "listens"]

FACTS = (
    "graph_id string, file string, language string, fact string, line long, kind string, spec string, is_package boolean"
)
USE = ["graph_id", "file", "line", "use_id"]


def extract_imports(files: DataFrame) -> DataFrame:
    """Facts of each source file: rows of fact ``use`` (imports) and ``declaration`` (top-level symbols)."""
    known = [*imports._USES, "python"]
    source = files if "language" in files.columns else detect_language(files)
    source = source.filter(F.col("language").isin(*known) & F.col("content").isNotNull()).select("graph_id", "path", "language", "content")

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split(" ")[0] for f in FACTS.split(", ")]
        for pdf in parts:
            rows: list[tuple] = []
            for g, path, lang, text in pdf.itertuples(index=False):
                rows += [(g, path, lang, "use", n, k, s, p) for n, k, s, p in imports.uses(lang, text)]
                rows += [(g, path, lang, "declaration", n, "symbol", s, False) for s, n in imports.declarations(lang, text)]
            yield pd.DataFrame(rows, columns=names)

    return source.mapInPandas(batches, FACTS)


def uses_of(facts: DataFrame) -> DataFrame:
    """Uses with an ordered candidate list; an import has one candidate."""
    one = F.array(F.struct("kind", "spec", "is_package"))
    return facts.filter("fact = 'use'").select(
        "graph_id", "file", "language", "line", sha256_text(F.concat_ws("|", "file", "line", "kind", "spec", "is_package")).alias("use_id"), one.alias("candidates")
    )


def unique_symbols(declarations: DataFrame) -> DataFrame:
    """Files that declare each symbol: 1 is unique, more are ambiguous."""
    return declarations.groupBy("graph_id", "language", "symbol").agg(F.countDistinct("file").alias("n_files"), F.min("file").alias("file"))


def normal_join(base: Column, rel: Column) -> Column:
    """``base/rel`` with ``.`` and ``..`` resolved; null if it climbs above the root."""
    parts = F.filter(F.split(F.concat(base, F.lit("/"), rel), "/"), lambda s: (s != "") & (s != "."))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(True).alias("ok"))

    def step(acc: Column, seg: Column) -> Column:
        n = F.size(acc["out"])
        up = seg == ".."
        return F.struct(
            F.when(up, F.slice(acc["out"], 1, F.greatest(n - 1, F.lit(0)))).otherwise(F.concat(acc["out"], F.array(seg))).alias("out"),
            (acc["ok"] & (~up | (n > 0))).alias("ok"),
        )

    return F.aggregate(parts, start, step, lambda acc: F.when(acc["ok"], F.array_join(acc["out"], "/")))


def _roots(col: str) -> Column:
    """Directories of a file from its own up to ``""``."""
    return F.concat(F.reverse(path_prefixes(col, with_self=False)), F.array(F.lit("")))


def _under(root: Column, rest: Column) -> Column:
    return F.when(root == "", rest).otherwise(F.concat(root, F.lit("/"), rest))


def probe_module_paths(uses: DataFrame, files: DataFrame, manifests: DataFrame | None = None, owners: DataFrame | None = None) -> DataFrame:
    """Files that path specifiers name: rows ``(USE, pos, target)``; a miss gives no row.

    ``uses`` as from uses_of; ``manifests`` (graph_id, dir, kind go|php|rust, name, value) holds module paths,
    PSR-4 prefixes with their directory, and crate names with their source directory; ``owners`` (graph_id,
    path, node_path) decides packages that are split.
    """
    cand = uses.select("graph_id", "file", "line", "use_id", "language", F.posexplode("candidates").alias("pos", "c")).filter(
        "c.kind = 'path'"
    ).select("graph_id", "file", "line", "use_id", "language", "pos", F.col("c.spec").alias("spec"), F.col("c.is_package").alias("is_package"))
    key = [*USE, "pos"]
    index = files.select("graph_id", F.col("path").alias("target")).distinct()
    here = parent_path("file")
    lang = F.col("language")
    arr = lambda *xs: F.array(*xs)

    def exist(rows: DataFrame) -> DataFrame:
        # a path many imports try is one hot key, and every path tried is shuffled once
        return salted_join(rows.filter("target is not null"), index, ["graph_id", "target"], "left_semi")

    def first(rows: DataFrame) -> DataFrame:
        return exist(rows).groupBy(*key).agg(F.min_by("target", "rank").alias("target"))

    # one ordered list of paths, the first that exists wins
    ts = normal_join(here, F.col("spec"))
    ext = F.regexp_extract(F.substring_index(ts, "/", -1), r"(\.[^.]*)$", 1)
    stem = F.regexp_replace(ts, r"\.[^./]*$", "")
    plus = lambda base, exts: arr(*[F.concat(base, F.lit(e)) for e in exts])
    rewrites = (
        F.when(ext == ".js", plus(stem, [".ts", ".tsx", ".js", ".jsx"]))
        .when(ext == ".jsx", plus(stem, [".tsx", ".jsx"]))
        .when(ext == ".mjs", plus(stem, [".mts", ".mjs"]))
        .when(ext == ".cjs", plus(stem, [".cts", ".cjs"]))
        .when(ext.isin(".ts", ".tsx", ".mts", ".cts"), arr(ts))
        .otherwise(plus(ts, [".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs"]))
    )
    ts_list = F.concat(rewrites, plus(ts, ["/index.ts", "/index.tsx", "/index.js", "/index.jsx"]))
    spec = F.col("spec")
    dots = F.length(F.regexp_extract(spec, r"^(\.+)", 1))
    py_tail = F.translate(F.regexp_replace(spec, r"^\.+", ""), ".", "/")
    py_base = normal_join(here, F.repeat(F.lit("../"), F.greatest(dots - 1, F.lit(0))))
    py_at = _under(py_base, py_tail)
    py_rel = F.when(py_tail == "", arr(_under(py_base, F.lit("__init__.py")))).otherwise(
        arr(F.concat(py_at, F.lit(".py")), F.concat(py_at, F.lit("/__init__.py")))
    )
    rb = normal_join(here, F.when(spec.endswith(".rb"), spec).otherwise(F.concat(spec, F.lit(".rb"))))
    inc = F.when(spec != "", normal_join(here, spec))
    lists = (
        F.when(lang.isin("typescript", "tsx", "javascript") & spec.rlike(r"^[./]"), ts_list)
        .when((lang == "python") & spec.startswith("."), py_rel)
        .when(lang == "ruby", arr(rb))
        .when(lang.isin("c", "cpp"), arr(inc))
    )
    listed = first(cand.select(*key, F.posexplode(lists).alias("rank", "target")))

    # searched from every ancestor directory
    up = cand.filter((lang == "python") & ~spec.startswith(".") | (lang == "java") & ~F.col("is_package"))
    up = up.select(*key, "language", "spec", F.posexplode(_roots("file")).alias("root_no", "root"))
    whole = F.array_join(F.filter(F.split("spec", r"\."), lambda s: s != ""), "/")
    above = parent_path(whole)
    py4 = arr(F.concat(whole, F.lit(".py")), F.concat(whole, F.lit("/__init__.py")),
              F.when(above != "", F.concat(above, F.lit(".py"))), F.when(above != "", F.concat(above, F.lit("/__init__.py"))))
    java2 = arr(F.concat(whole, F.lit(".java")), F.when(above != "", F.concat(above, F.lit(".java"))))
    tries = up.select(
        *key, "language", "root_no", "root",
        F.posexplode(F.when(lang == "python", py4).otherwise(java2)).alias("rank", "rest"),
    ).filter("rest is not null").withColumn("target", _under(F.col("root"), F.col("rest")))
    per_root = exist(tries).groupBy(*key, "language", "root_no").agg(F.min_by("target", "rank").alias("target"))
    searched = per_root.groupBy(*key, "language").agg(
        F.countDistinct("target").alias("n"), F.min_by("target", "root_no").alias("target")
    ).filter("language = 'java' or n = 1").select(*key, "target")

    out = listed.unionByName(searched)
    folder = files.select("graph_id", F.col("path").alias("target"), parent_path("path").alias("dir"))
    if owners is not None:
        owned = owners.filter("node_path is not null").select("graph_id", F.col("path").alias("target"), "node_path")
        # a package import: nearest root with sources in the directory, one owner among them
        pk = cand.filter((lang == "java") & F.col("is_package")).select(*key, "spec", F.posexplode(_roots("file")).alias("root_no", "root"))
        pk = pk.withColumn("dir", _under(F.col("root"), F.translate("spec", ".", "/")))
        src = shuffled_join(folder.filter(F.col("target").endswith(".java")), owned, ["graph_id", "target"], "left").groupBy("graph_id", "dir").agg(
            F.countDistinct("node_path").alias("n"), F.min(F.when(F.col("node_path").isNotNull(), F.col("target"))).alias("target")
        )
        hit = salted_join(pk, src, ["graph_id", "dir"]).groupBy(*key).agg(F.min_by(F.struct("n", "target"), "root_no").alias("h"))
        out = out.unionByName(hit.filter("h.n = 1").select(*key, F.col("h.target").alias("target")))
    if manifests is None:
        return out
    near = salted_join(
        cand.filter(lang.isin("go", "php", "rust")).select(*key, "language", "file", "spec", F.posexplode(_roots("file")).alias("root_no", "dir")),
        manifests.select("graph_id", "dir", F.col("kind").alias("language"), "name", "value"), ["graph_id", "dir", "language"],
    )
    closest = near.groupBy(*key).agg(F.min("root_no").alias("root_no"))
    near = shuffled_join(near, closest, [*key, "root_no"])
    # go: the rest of the path after the module is a directory
    go = near.filter("language = 'go'").filter((F.col("spec") == F.col("name")) | F.col("spec").startswith(F.concat("name", F.lit("/"))))
    rest = F.expr("substring(spec, length(name) + 2)")
    go = go.withColumn("dir", F.when(rest == "", F.col("dir")).otherwise(_under(F.col("dir"), rest)))
    prod = folder.filter(F.col("target").endswith(".go")).withColumn("test", F.col("target").endswith("_test.go"))
    has = prod.groupBy("graph_id", "dir").agg(F.bool_or(~F.col("test")).alias("has_prod"))
    prod = salted_join(prod, has, ["graph_id", "dir"]).filter(~F.col("test") | ~F.col("has_prod"))
    if owners is not None:
        prod = shuffled_join(prod, owned, ["graph_id", "target"], "left")
    else:
        prod = prod.withColumn("node_path", F.lit(None).cast("string"))
    packs = prod.groupBy("graph_id", "dir").agg(
        F.countDistinct("node_path").alias("n"),
        F.coalesce(F.min(F.when(F.col("node_path").isNotNull(), F.col("target"))), F.min("target")).alias("target"),
    ).filter("n <= 1")
    out = out.unionByName(salted_join(go.select(*key, "dir"), packs, ["graph_id", "dir"]).select(*key, "target"))
    # php: the longest prefix, then exactly one file
    php = near.filter("language = 'php'").filter(F.concat("spec", F.lit("\\")).startswith(F.col("name")))
    longest = php.groupBy(*key).agg(F.max(F.length("name")).alias("len"))
    php = shuffled_join(php, longest, key).filter("length(name) = len")
    php = exist(php.withColumn("target", _under(F.regexp_replace("value", "/$", ""), F.concat(F.translate(F.expr("substring(spec, len + 1)"), "\\", "/"), F.lit(".php")))))
    out = out.unionByName(php.groupBy(*key).agg(F.countDistinct("target").alias("n"), F.min("target").alias("target")).filter("n = 1").select(*key, "target"))
    # rust: crate, own crate name, self and super, longest module path first
    rust = near.filter("language = 'rust'").withColumn("segs", F.filter(F.split("spec", "::"), lambda s: s != ""))
    head = F.col("segs")[0]
    own_dir = F.when(
        F.regexp_replace(F.substring_index("file", "/", -1), r"\.rs$", "").isin("mod", "lib", "main"), parent_path("file")
    ).otherwise(F.regexp_replace("file", r"\.rs$", ""))
    climbs = F.size(F.filter("segs", lambda s: s == "super"))
    start = F.when((head == "crate") | (head == F.col("name")), F.col("value")).when(
        head.isin("self", "super"), normal_join(own_dir, F.repeat(F.lit("../"), climbs))
    )
    tail = F.when(head.isin("self", "super"), F.filter("segs", lambda s: ~s.isin("self", "super"))).otherwise(F.slice("segs", F.lit(2), F.size("segs")))
    rust = rust.withColumn("start", start).withColumn("tail", tail).filter("start is not null")
    inside = (F.col("start") == F.col("value")) | F.col("start").startswith(F.concat("value", F.lit("/"))) | (F.col("value") == "")
    rust = rust.filter(inside)
    walk = F.when(
        F.size("tail") > 0,
        F.flatten(F.transform(F.reverse(F.sequence(F.lit(1), F.size("tail"))), lambda k: F.array(
            F.concat(_under(F.col("start"), F.array_join(F.slice("tail", F.lit(1), k), "/")), F.lit(".rs")),
            F.concat(_under(F.col("start"), F.array_join(F.slice("tail", F.lit(1), k), "/")), F.lit("/mod.rs")),
        ))),
    ).otherwise(F.array(_under(F.col("start"), F.lit("mod.rs")), F.concat("start", F.lit(".rs"))))
    return out.unionByName(first(rust.select(*key, F.posexplode(walk).alias("rank", "target"))))


def resolve_candidates(uses: DataFrame, symbols: DataFrame, targets: DataFrame, owners: DataFrame) -> DataFrame:
    """Owner each use points to: rows ``(USE, source file, node_path)``.

    Candidates are walked in order: absent ones are passed over, an ambiguous one silences the use, the first
    resolved one wins. A target without an owner counts as absent. ``symbols`` comes from unique_symbols,
    ``targets`` from probe_module_paths.
    """
    key = [*USE, "pos"]
    cand = uses.select("graph_id", "file", "line", "use_id", "language", F.posexplode("candidates").alias("pos", "c")).select(
        *key, "language", "c.kind", "c.spec"
    )
    own = owners.filter("node_path is not null").select("graph_id", F.col("path").alias("target"), "node_path")
    # owners are looked up per distinct target and per symbol: a popular file is one row there
    owned = shuffled_join(targets.select("graph_id", "target").distinct(), own, ["graph_id", "target"])
    by_path = salted_join(shuffled_join(cand.filter("kind = 'path'"), targets.select(*key, "target"), key), owned, ["graph_id", "target"]).select(
        *key, "node_path", F.lit(False).alias("ambiguous")
    )
    table = symbols.select("graph_id", "language", F.col("symbol").alias("spec"), "n_files", F.col("file").alias("target"))
    table = shuffled_join(table, own, ["graph_id", "target"], "left")
    by_symbol = (
        salted_join(cand.filter("kind = 'symbol'"), table, ["graph_id", "language", "spec"])
        .select(*key, "node_path", (F.col("n_files") > 1).alias("ambiguous"))
        .filter("ambiguous or node_path is not null")
    )
    first = by_path.unionByName(by_symbol).groupBy(*USE).agg(F.min_by(F.struct("ambiguous", "node_path"), "pos").alias("f"))
    return first.filter(~F.col("f.ambiguous")).select(*USE, F.col("f.node_path").alias("target"))


def code_edges(resolved: DataFrame, owners: DataFrame) -> DataFrame:
    """Resolved uses with the owner of the using file as ``source``."""
    own = owners.filter("node_path is not null").select("graph_id", F.col("path").alias("file"), F.col("node_path").alias("source"))
    return shuffled_join(resolved, own, ["graph_id", "file"]).select("graph_id", "source", "target", "file", "line")


def _cross(edges: DataFrame) -> DataFrame:
    same = F.col("source") == F.col("target")
    line = F.col("source").startswith(F.concat("target", F.lit("/"))) | F.col("target").startswith(F.concat("source", F.lit("/")))
    return edges.filter(~same & ~line)


def detected_edges(edges: DataFrame) -> DataFrame:
    """Distinct edges between nodes that are not in one line of containment."""
    return _cross(edges).select("graph_id", "source", "target").distinct()


PAIR = ["graph_id", "source", "target"]


def _hashed(rows: DataFrame, name: str, *keys: str) -> DataFrame:
    """``rows`` with a hash of the keys to join by first: sorts compare one number where names start alike."""
    return rows.withColumn(name, F.xxhash64(*keys))


def _detected(edges: DataFrame) -> DataFrame:
    """``detected_edges`` with the hash ``_h`` of the pair."""
    return _hashed(_cross(edges).select(*PAIR), "_h", *PAIR).distinct()


def _undeclared(pairs: DataFrame, relations: DataFrame, hashed: bool = False) -> DataFrame:
    """``undeclared_pairs`` of distinct pairs with their hash ``_h``, which stays only if ``hashed``."""
    declared = _hashed(relations.select(*PAIR), "_h", *PAIR).distinct()
    # only pairs without a declaration of their own are asked for each ancestor
    rest = shuffled_join(pairs, declared, ["_h", *PAIR], "left_anti").drop("_h")
    up = F.size(F.split("target", "/")) - 1
    rest = rest.withColumn("_k", F.explode_outer(F.when(up > 0, F.sequence(F.lit(1), up)))).withColumn("_via", F.expr("substring_index(target, '/', _k)")).drop("_k")
    above = declared.select("graph_id", "source", F.col("target").alias("_via"), F.col("_h").alias("_v"), F.lit(True).alias("_ok"))
    found = shuffled_join(_hashed(rest, "_v", "graph_id", "source", "_via"), above, ["_v", "graph_id", "source", "_via"], "left")
    key = ["_h", *PAIR] if hashed else PAIR
    return _hashed(found, "_h", *PAIR).groupBy(*key).agg(F.max("_ok").alias("_ok")).filter("_ok IS NULL").select(*key)


def undeclared_pairs(pairs: DataFrame, relations: DataFrame) -> DataFrame:
    """The distinct detected ``pairs`` of nodes without a declared relation to the target or to an ancestor of it."""
    return _undeclared(_hashed(pairs.select(*PAIR), "_h", *PAIR), relations)


def undeclared_dependencies(edges: DataFrame, relations: DataFrame) -> DataFrame:
    """Uses across nodes without a declared relation to the target or to an ancestor of it."""
    # distinct node pairs meet the declarations; the uses themselves only once at the end
    bad = _undeclared(_detected(edges), relations, hashed=True)
    return salted_join(_hashed(edges.distinct(), "_h", *PAIR), bad, ["_h", *PAIR], "left_semi").select(*edges.columns)


def allowed_relation_types(types: DataFrame, pairs: DataFrame) -> DataFrame:
    """Relation types permitted between two node types: adds ``allowed`` in canonical order.

    ``types`` carries ``relations`` (map of type to target list) and ``relation_default``; ``pairs`` has
    ``from_type`` and ``to_type``.
    """
    model = types.select("graph_id", F.col("type").alias("from_type"), "relations", "relation_default")
    rows = salted_join(pairs, model.withColumn("_known", F.lit(True)), ["graph_id", "from_type"], "left")
    listed = lambda t: F.try_element_at("relations", F.lit(t))
    allows = lambda t: F.when(
        listed(t).isNull(), F.coalesce("relation_default", F.lit("allow")) == "allow"
    ).otherwise(F.array_contains(listed(t), "*") | F.array_contains(listed(t), F.col("to_type")))
    names = F.array_compact(F.array(*[F.when(allows(t), F.lit(t)) for t in RELATION_TYPES]))
    return rows.withColumn("allowed", F.when(F.col("_known"), names).otherwise(F.array().cast("array<string>"))).drop(
        "relations", "relation_default", "_known"
    )


def _sanctioned(pairs: DataFrame, nodes: DataFrame, types: DataFrame) -> DataFrame:
    t = nodes.select("graph_id", "node_path", "type")
    pairs = shuffled_join(pairs, t.select("graph_id", F.col("node_path").alias("source"), F.col("type").alias("from_type")), ["graph_id", "source"])
    pairs = shuffled_join(pairs, t.select("graph_id", F.col("node_path").alias("target"), F.col("type").alias("to_type")), ["graph_id", "target"])
    return allowed_relation_types(types, pairs)


def sanctioning_relations(violations: DataFrame, nodes: DataFrame, types: DataFrame) -> DataFrame:
    """Per undeclared edge, the relation types that would sanction it, or none."""
    return _sanctioned(violations.select(*PAIR).distinct(), nodes, types)


def boundary_report(nodes: DataFrame, relations: DataFrame, edges: DataFrame, types: DataFrame) -> DataFrame:
    """Edge classes: undeclared, declared-only, forbidden-type. The detected pairs are written once to the shared folder."""
    found = cut_lineage(detected_edges(edges))
    hashed = _hashed(found, "_h", *PAIR)
    pick = lambda df, c: df.select(*PAIR, F.lit(c).alias("class"))
    undeclared = _undeclared(hashed, relations)
    known = nodes.select("graph_id", F.col("node_path").alias("target"))
    declared = _hashed(_cross(relations.filter(F.col("type").isin(*STRUCTURAL))).select(*PAIR), "_h", *PAIR).distinct()
    only = shuffled_join(declared, hashed, ["_h", *PAIR], "left_anti")
    only = shuffled_join(only, known, ["graph_id", "target"], "left_semi")
    model = _sanctioned(found, nodes, types)
    has_model = types.select("graph_id", F.col("type").alias("from_type"))
    forbidden = salted_join(model, has_model, ["graph_id", "from_type"], "left_semi").filter(
        ~F.arrays_overlap("allowed", F.array(*[F.lit(t) for t in STRUCTURAL]))
    )
    # the pairs of a class are distinct but for nodes that are listed twice
    return pick(undeclared, "undeclared").unionByName(pick(only, "declared-only")).unionByName(pick(forbidden, "forbidden-type").distinct())


def fact_keys(files: DataFrame, version: str) -> DataFrame:
    """Adds the cache key: digest of content, language and extractor version, 128 bits wide."""
    text = F.concat_ws("|", sha256_text("content"), F.coalesce("language", F.lit("")), F.lit(version))
    return files.withColumn("fact_key", F.substring(sha256_text(text), 1, 32))


def incremental_facts(
    files: DataFrame, cache: DataFrame, extract: Callable[[DataFrame], DataFrame], version: str
) -> tuple[DataFrame, DataFrame]:
    """Facts of all files, extracting only those whose key the cache lacks; and the new cache rows.

    ``extract`` gets one representative file per new key and returns rows with ``graph_id`` and ``file``.
    """
    keyed = fact_keys(files, version)
    fresh = shuffled_join(keyed, cache.select("fact_key").distinct(), ["fact_key"], "left_anti")
    one = fresh.groupBy("fact_key").agg(F.min(F.struct("graph_id", "path", "language", "content")).alias("f")).select("fact_key", "f.*")
    body = extract(one.drop("fact_key"))
    new = shuffled_join(body, one.select("fact_key", "graph_id", F.col("path").alias("file")), ["graph_id", "file"]).drop("graph_id", "file")
    known = cache.unionByName(new.select(*cache.columns))
    places = keyed.select("fact_key", "graph_id", F.col("path").alias("file"))
    return salted_join(places, known, ["fact_key"]), new


def audit_cache(cached: DataFrame, fresh: DataFrame) -> DataFrame:
    """Rows that differ between facts with and without the cache, duplicates counted."""
    cols = sorted(fresh.columns)
    a, b = cached.select(*cols), fresh.select(*cols)
    only = lambda x, y, side: x.exceptAll(y).withColumn("side", F.lit(side))
    return only(a, b, "cached-only").unionByName(only(b, a, "fresh-only"))


def imported_symbols(facts: DataFrame, symbols: DataFrame) -> DataFrame:
    """Index from a last name to the declared symbols that a project-wide import reaches: ``name, symbol, rank``.

    ``facts`` (graph_id, language, spec) are prefixes. A symbol is reached if what stands before its last name is one
    of them, which is an equality; names of one language are ranked by symbol.
    """
    key = ["graph_id", "language"]
    last = F.substring_index("symbol", ".", -1)
    split = symbols.filter(F.col("symbol").contains(".")).select(
        *key, "symbol", last.alias("name"), F.expr("left(symbol, length(symbol) - length(substring_index(symbol, '.', -1)) - 1)").alias("spec")
    )
    reached = salted_join(split.distinct(), facts.select(*key, "spec").distinct(), [*key, "spec"], "left_semi")
    # the symbols of one name, a part of the declarations
    return reached.select(*key, "name", "symbol").withColumn("rank", F.row_number().over(Window.partitionBy(*key, "name").orderBy("symbol")))


def global_imports(facts: DataFrame, uses: DataFrame, symbols: DataFrame) -> DataFrame:
    """Symbols that exist and that project-wide imports offer to each use, behind its own candidates.

    The last name of a use's first candidate meets the index of names; a use gets a row for each symbol that is
    declared, with ``pos`` as the place after its own, and no row for a prefix that has no such symbol.
    """
    name = F.substring_index(F.get("candidates", F.lit(0))["spec"], ".", -1)
    named = uses.withColumn("_own", F.size("candidates")).withColumn("name", name).drop("candidates")
    found = salted_join(named, imported_symbols(facts, symbols), ["graph_id", "language", "name"])
    return found.withColumn("pos", (F.col("_own") + F.col("rank") - 1).cast("int")).drop("_own", "rank", "name")
