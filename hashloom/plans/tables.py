"""The shared tables in the roles that the operators expect: names, hierarchies, sentences, decoded apps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def sentences_of(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "[.!?\\n]+"), lambda s: F.trim(s)), lambda s: s != "")


def sentences(docs: DataFrame, key: str) -> DataFrame:
    """key, pos, sentence of each row."""
    return docs.select(key, F.posexplode(sentences_of(F.col("text"))).alias("pos", "sentence"))


def page_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, name: a page's host from the top level down, then its path."""
    pages = read(spark, sf_dir, "pages")
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1)
    path = F.regexp_extract("url", "^[a-z]+://[^/?#]+([^?#]*)", 1)
    segments = F.filter(F.split(F.regexp_replace(path, "[.].*$", ""), "/"), lambda s: s != "")
    return pages.select("page_id", F.array_join(F.concat(F.reverse(F.split(host, "[.]")), segments), ".").alias("name"))


def customer_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region, nation, customer, hash of every order."""
    leaf = F.md5(F.concat("o_orderpriority", "o_orderstatus"))
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("customer"), leaf.alias("hash"))
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer"), F.col("c_nationkey").alias("nation"))
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("region"))
    return o.join(c, "customer").join(n, "nation")


CODE = "array<struct<pc:int,opcode:string,kind:string,ref_class:string,arg_types:array<string>,field_type:string>>"


def decoded_apps(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Decoded tables: a region is an app, a nation a package, a customer a class, an order a method, its lines the code.

    Lines and orders are shuffled as they are read; names and code are made of them behind the last join.
    """
    nation = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    cls = F.concat(F.lit("Lcom/"), "n_name", F.lit("/C"), "c_custkey", F.lit(";"))
    c = read(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    classes = c.select(F.col("r_name").alias("app_id"), cls.alias("class_desc"), F.lit("Lfw/Base;").alias("super_desc"), (F.col("c_custkey") % 2).cast("int").alias("access_flags"), F.col("c_mktsegment").alias("source_file"), "c_custkey")
    s = read(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), F.col("n_name").alias("home"))

    def decoded(x: Column) -> Column:
        kind = F.when(x["l_linestatus"] == "O", F.lit("invoke")).otherwise(F.lit("getfield"))
        flag = F.concat(F.lit("L"), x["l_returnflag"], F.lit(";"))
        ref = F.concat(F.lit("Lcom/"), x["home"], F.lit("/S"), x["l_suppkey"].cast("string"), F.lit(";"))
        return F.struct(x["l_linenumber"].cast("int").alias("pc"), F.concat(F.lit("op-"), x["l_returnflag"]).alias("opcode"), kind.alias("kind"), ref.alias("ref_class"), F.array(F.lit("I"), flag, F.lit("V")).alias("arg_types"), flag.alias("field_type"))

    line = F.struct("l_linenumber", "l_returnflag", "l_linestatus", "home", "l_suppkey")
    lines = read(spark, sf_dir, "lineitem").join(s, "l_suppkey").groupBy("l_orderkey").agg(F.collect_list(line).alias("lines"))
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus").join(c.select("c_custkey", "r_name", "n_name"), F.col("o_custkey") == F.col("c_custkey"))
    methods = o.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        F.col("r_name").alias("app_id"),
        cls.alias("class_desc"),
        F.col("o_orderkey").cast("int").alias("method_idx"),
        F.concat(F.lit("m"), "o_orderkey").alias("name"),
        F.lit(1).alias("access_flags"),
        F.array(F.lit("I"), F.concat(F.lit("L"), "o_orderstatus", F.lit(";"))).alias("param_types"),
        F.lit("V").alias("return_type"),
        F.sort_array(F.transform("lines", decoded)).cast(CODE).alias("code"),
    )
    apps = nation.select(F.col("r_name").alias("app_id")).distinct().select("app_id", F.concat(F.lit("org.app."), F.lower("app_id")).alias("package_name"))
    framework = spark.sql("SELECT * FROM VALUES ('LO;'), ('LF;'), ('LN;'), ('LA;') AS t(type_desc)")
    return {"apps": apps, "classes": classes.drop("c_custkey"), "methods": methods, "framework_types": framework}
