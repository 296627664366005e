"""What is read off node tables: numbers, a library's parts, entry points (PRJ-04, PRJ-05, FN-26, FLT-15, GR-04)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .components import connected_components
from .filters import app_prefix, is_resource
from ..functions import names as nm
from ..storage import materialize, sized

# The methods that the platform calls by itself, by a class's category.
LIFECYCLE = {
    "Activity": (
        "onCreate(Landroid/os/Bundle;)V",
        "onStart()V",
        "onResume()V",
        "onPostResume()V",
        "onRestoreInstanceState(Landroid/os/Bundle;)V",
        "onPostCreate(Landroid/os/Bundle;)V",
        "onSaveInstanceState(Landroid/os/Bundle;)V",
        "onPause()V",
        "onStop()V",
        "onRestart()V",
        "onDestroy()V",
        "onActivityResult(IILandroid/content/Intent;)V",
        "onNewIntent(Landroid/content/Intent;)V",
    ),
    "Service": (
        "onCreate()V",
        "onDestroy()V",
        "onStart(Landroid/content/Intent;I)V",
        "onStartCommand(Landroid/content/Intent;II)I",
        "onBind(Landroid/content/Intent;)Landroid/os/IBinder;",
        "onRebind(Landroid/content/Intent;)V",
        "onUnbind(Landroid/content/Intent;)Z",
    ),
    "BroadcastReceiver": ("onReceive(Landroid/content/Context;Landroid/content/Intent;)V",),
    "ContentProvider": ("onCreate()Z",),
    "Application": (
        "onCreate()V",
        "onTerminate()V",
        "onActivityStarted(Landroid/app/Activity;)V",
        "onActivityStopped(Landroid/app/Activity;)V",
        "onActivitySaveInstanceState(Landroid/app/Activity;Landroid/os/Bundle;)V",
        "onActivityResumed(Landroid/app/Activity;)V",
        "onActivityPaused(Landroid/app/Activity;)V",
        "onActivityDestroyed(Landroid/app/Activity;)V",
        "onActivityCreated(Landroid/app/Activity;Landroid/os/Bundle;)V",
    ),
    "Fragment": (
        "onAttach(Landroid/app/Activity;)V",
        "onCreate(Landroid/os/Bundle;)V",
        "onCreateView(Landroid/view/LayoutInflater;Landroid/view/ViewGroup;Landroid/os/Bundle;)Landroid/view/View;",
        "onActivityCreated(Landroid/os/Bundle;)V",
        "onViewStateRestored(Landroid/os/Bundle;)V",
        "onStart()V",
        "onResume()V",
        "onPause()V",
        "onStop()V",
        "onDestroyView()V",
        "onDestroy()V",
        "onDetach()V",
    ),
}


def is_lifecycle(category: Column, signature: Column, table: dict[str, tuple[str, ...]] = LIFECYCLE) -> Column:
    """Whether the platform calls a method with this signature of a class of this category (FN-26)."""
    known = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.coalesce(F.array_contains(F.element_at(known, category), signature), F.lit(False))


def useful(simple: Column, n_methods: Column, n_fields: Column, n_interfaces: Column) -> Column:
    """Neither a resource class nor an empty anonymous inner class (FLT-15)."""
    anonymous = simple.rlike(r"\$[0-9]+$")
    return ~(anonymous & (n_methods == 0) & (n_fields == 0) & (n_interfaces == 0)) & ~is_resource(simple)


def numbers(nodes: dict[str, DataFrame]) -> DataFrame:
    """app_id, n_packages, n_classes, n_methods (PRJ-04): sums of one row a package."""
    return nodes["packages"].groupBy("app_id").agg(F.count("*").alias("n_packages"), F.sum("n_classes").alias("n_classes"), F.sum("n_methods").alias("n_methods"))


def method_hashes(nodes: dict[str, DataFrame]) -> DataFrame:
    """app_id, hash: all method hashes in order (PRJ-04), by a range sort that gathers no app in one row."""
    return nodes["methods"].select("app_id", "hash").sort("app_id", "hash")


def library(nodes: dict[str, DataFrame], key: str = "app_id") -> DataFrame:
    """key, name, packages, n_classes (PRJ-05): a library is named by its smallest package."""
    return nodes["packages"].groupBy(key).agg(F.min("package").alias("name"), F.sort_array(F.collect_set("package")).alias("packages"), F.sum("n_classes").alias("n_classes"))


def class_components(edges: DataFrame, apps: DataFrame) -> DataFrame:
    """app_id, class_name, component of class edges (app_id, src, dst) outside the app itself (GR-04).

    Rounds go by numbers of the classes, which are shorter than their names.
    """
    rows = edges.join(apps.select("app_id", app_prefix(F.col("package_name")).alias("own")), "app_id")
    rows = rows.filter(~F.col("src").startswith(F.col("own")) & ~F.col("dst").startswith(F.col("own")))
    key = lambda c: F.concat_ws("\0", "app_id", c)
    pairs = materialize(rows.select(key("src").alias("a"), key("dst").alias("b")), "pairs")
    named = materialize(pairs.select(F.col("a").alias("name")).union(pairs.select("b")).distinct().withColumn("id", F.monotonically_increasing_id()), "named")
    of = lambda end: sized(named.withColumnsRenamed({"name": end, "id": f"{end}_id"}))
    numbered = materialize(pairs.join(of("a"), "a").join(of("b"), "b").select("a_id", "b_id"), "numbered")
    parts = connected_components(numbered, "a_id", "b_id").join(named.withColumnRenamed("id", "node"), "node")
    first = parts.groupBy("component").agg(F.min("name").alias("first"))
    made = parts.join(first, "component")
    return made.select(F.split("name", "\0")[0].alias("app_id"), F.split("name", "\0")[1].alias("class_name"), F.split("first", "\0")[1].alias("component"))


def class_edges(classes: DataFrame, methods: DataFrame) -> DataFrame:
    """app_id, src, dst: distinct uses between different classes of one app."""
    own = classes.select("app_id", F.col("class_desc").alias("d")).distinct()
    code = methods.select("app_id", "class_desc", F.explode("code").alias("i")).filter(F.col("i.ref_class").isNotNull())
    e = code.select("app_id", F.col("class_desc").alias("s"), F.col("i.ref_class").alias("d")).distinct()
    e = e.unionByName(classes.filter("super_desc IS NOT NULL").select("app_id", F.col("class_desc").alias("s"), F.col("super_desc").alias("d")))
    e = e.join(own, ["app_id", "d"], "left_semi").filter("s <> d")
    return e.select("app_id", nm.dotted(F.col("s")).alias("src"), nm.dotted(F.col("d")).alias("dst")).distinct()
