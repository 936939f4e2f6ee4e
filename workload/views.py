"""Stand-ins for crawled repositories, source lines and jobs, over the given tables."""

from pyspark.sql import functions as F

from reporank.functions.minhash import minhash
from reporank.schemas import VECTOR
from reporank.session import written

AS_OF = "2001-08-01"


SCHEMAS = {
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
    "c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
    "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
    "value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def table(spark, folder, name):
    """A given table, with its declared schema: no job to look at the files."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def spread(df):
    """Input of fewer splits than cores is spread over all cores; larger input stays put."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def repos(spark, folder):
    """One flat row per customer standing in for a crawled repository."""
    orders, customer = table(spark, folder, "orders"), table(spark, folder, "customer")
    lines = spread(
        table(spark, folder, "lineitem").select(
            "l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_returnflag"
        )
    )
    is_closed = F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)
    by_order = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count("*").alias("forks"),
        F.max("o_orderdate").alias("last_commit"),
        F.sum(1 - is_closed).alias("open_issues"),
        F.avg(is_closed.cast("double")).alias("issue_close_rate"),
    )
    by_line = (
        orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
        .groupBy(F.col("o_custkey").alias("c_custkey"))
        .agg(
            F.avg(F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0)).alias(
                "test_file_ratio"
            ),
            # summed as whole hundredths: a sum of doubles depends on the order of the rows
            (
                F.sum(F.round(F.col("l_discount") * 100).cast("long")).cast("double")
                / (100 * F.count("*"))
            ).alias("error_handling_density"),
            F.count_distinct("l_partkey").alias("public_api_count"),
            F.sum("l_quantity").cast("long").alias("total_lines"),
            F.count_distinct("l_suppkey").alias("contributor_count"),
        )
    )
    key = F.col("c_custkey")
    languages = F.array(*map(F.lit, ["Python", "Go", "JavaScript", "Java"]))
    return (
        customer.join(by_order, "c_custkey", "left")
        .join(by_line, "c_custkey", "left")
        .select(
            key.alias("repo_id"),
            F.col("c_nationkey").alias("job_id"),
            F.col("c_name").alias("full_name"),
            F.concat(F.lit("https://repos.example/"), "c_name").alias("url"),
            F.get(languages, F.col("c_nationkey") % 5).alias("language"),
            F.when(key % 17 != 0, F.lower("c_mktsegment")).alias("description"),
            F.greatest(F.floor("c_acctbal"), F.lit(0)).cast("long").alias("stars"),
            F.coalesce("forks", F.lit(0)).alias("forks"),
            F.coalesce("open_issues", F.lit(0)).alias("open_issues"),
            "last_commit",
            F.when(
                key % 23 != 5, F.datediff(F.lit(AS_OF).cast("date"), F.col("last_commit"))
            ).alias("commit_recency"),
            "test_file_ratio",
            "error_handling_density",
            "public_api_count",
            "total_lines",
            F.when(key % 23 != 6, F.col("contributor_count")).alias("contributor_count"),
            "issue_close_rate",
        )
    )


def records(flat):
    """Flat repositories as nested repository records."""
    ast = [
        "public_api_count",
        "test_file_ratio",
        "error_handling_density",
        "total_lines",
    ]
    stats = F.struct(
        "contributor_count", F.col("commit_recency").cast("long").alias("commit_recency"), "issue_close_rate"
    )
    prints = ["minhash_fingerprint"] if "minhash_fingerprint" in flat.columns else []
    vector = ["embedding"] if "embedding" in flat.columns else []
    return flat.select(
        "full_name",
        "url",
        "description",
        "language",
        "stars",
        "forks",
        F.struct(*ast, *prints).alias("ast"),
        stats.alias("contributor_stats"),
        "job_id",
        *vector,
    )


def with_vectors(flat, spark, folder):
    """Each repository gets the vector whose number is its own, modulo their count."""
    vectors = table(spark, folder, "embeddings")
    many = vectors.agg(F.count("*").alias("n")).scalar()
    slim = vectors.select("vec_id", F.col("embedding").cast(VECTOR).alias("embedding"))
    return flat.withColumn("vec_id", F.col("repo_id") % many).join(slim, "vec_id", "left")


def fingerprints(spark, folder):
    """Documents as repositories: key, fingerprint of the whole text, length as stars."""
    documents = spread(table(spark, folder, "documents").select("doc_id", "text", "n_chars"))
    return documents.select(
        "doc_id", minhash("text").alias("minhash_fingerprint"), F.col("n_chars").alias("stars")
    )


def landed_fingerprints(spark, folder):
    """Fingerprints as the crawl leaves them: a stored table, computed once."""
    return written(fingerprints(spark, folder))


def with_fingerprints(flat, spark, folder):
    """Each repository gets the document whose number is its own, modulo their count."""
    prints = fingerprints(spark, folder).drop("stars")
    many = table(spark, folder, "documents").agg(F.count("*").alias("n")).scalar()
    return flat.withColumn("doc_id", F.col("repo_id") % many).join(prints, "doc_id", "left")


def query_vector(spark, folder):
    """The vector of the question: one row, a parameter of the ranking."""
    row = table(spark, folder, "embeddings").filter("vec_id = 0").select("embedding").first()
    return [float(x) for x in row.embedding]


def items(flat):
    """Repositories as search items."""
    return flat.select(
        "full_name",
        F.col("url").alias("html_url"),
        "description",
        "language",
        F.col("stars").alias("stargazers_count"),
        F.col("forks").alias("forks_count"),
        F.col("open_issues").alias("open_issues_count"),
        F.array("description", "language").alias("topics"),
        F.col("last_commit").alias("updated_at"),
    )


def code_lines(spark, folder):
    """One source line per order line; a supplier is a repository.

    Lines cover every extension, public and private names, and shapes that the
    patterns leave out (bare except, Go methods with receiver, static Java).
    """
    ext = F.get(
        F.array(*map(F.lit, ["py", "go", "ts", "java", "js", "md"])),
        (F.col("p_partkey") % 6).cast("int"),
    )
    name, snake = F.replace("p_name", F.lit(" ")), F.replace("p_name", F.lit(" "), F.lit("_"))
    camel = F.concat(
        F.upper(F.substring("p_name", 1, 1)),
        F.replace(F.expr("substr(p_name, 2)"), F.lit(" ")),
    )
    lit, cat = F.lit, F.concat
    shapes = {
        "py": [
            cat(lit("def "), snake, lit("(x):")),
            cat(lit("  def _"), snake, lit(" (self):")),
            lit("except ValueError:"),
            lit("except:"),
        ],
        "go": [
            cat(lit("func "), camel, lit("(a int) error {")),
            cat(lit("func "), name, lit("()")),
            lit("\tif err != nil {"),
            cat(lit("func (r *T) "), name, lit("()")),
        ],
        "ts": [
            cat(lit("const "), name, lit(" = async (x) => 1")),
            cat(lit("export function "), name, lit("(")),
            lit("} catch (e) {"),
            cat(lit("const "), name, lit(" = x => 1")),
        ],
        "java": [
            cat(lit("public int "), name, lit("(")),
            lit("public static void main(String[] a)"),
            lit("} catch (E e) {"),
            lit("private int x("),
        ],
    }
    line = F.lit("plain text")
    for kind, texts in shapes.items():
        chosen = F.get(F.array(*texts), F.col("p_size") % 4)
        line = F.when(F.col("ext") == kind, chosen).otherwise(line)
    part = table(spark, folder, "part").withColumn("ext", ext)
    texts = part.select(F.col("p_partkey").alias("l_partkey"), "ext", line.alias("line"))
    lines = spread(
        table(spark, folder, "lineitem").select(
            "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"
        )
    )
    prefix = F.when(F.col("l_orderkey") % 7 == 0, "test_").otherwise("m_")
    return lines.join(texts, "l_partkey").select(
        F.col("l_suppkey").alias("repo"),
        F.concat(
            F.lit("src/"), prefix, (F.col("l_orderkey") % 20).cast("string"), F.lit("."), "ext"
        ).alias("path"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line_no"),
        "line",
    )


def code_files(spark, folder):
    """The code lines put together to whole files."""
    numbered = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    content = F.array_join(F.transform(numbered, lambda x: x["line"]), "\n")
    lines = code_lines(spark, folder)
    return lines.groupBy("repo", "path").agg(content.alias("content"))


def commits(spark, folder):
    """An order line is a commit to its customer's repository, by its supplier."""
    orders, lines = table(spark, folder, "orders"), table(spark, folder, "lineitem")
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_custkey").alias("repo"),
        F.col("l_suppkey").alias("author"),
        F.col("l_shipdate").alias("committed_at"),
    )


def issues(spark, folder):
    """An order is an issue, closed when its status is F."""
    return table(spark, folder, "orders").select(
        F.col("o_custkey").alias("repo"), (F.col("o_orderstatus") == "F").alias("closed")
    )


STATUS_OF = {"signup": "pending", "view": "running", "click": "running",
             "purchase": "done", "error": "failed"}


def job_events(spark, folder):
    """An event is a status change of the job of its user."""
    pairs = [F.lit(x) for pair in STATUS_OF.items() for x in pair]
    return table(spark, folder, "events").select(
        F.col("user_id").alias("job_id"),
        F.create_map(*pairs)[F.col("event_type")].alias("status"),
        F.col("ts").alias("updated_at"),
        F.col("event_id").alias("seq"),
    )


def stored_queries(spark, folder):
    """Every vector is a stored query; its job is its number."""
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("job_id"), F.col("embedding").cast(VECTOR).alias("embedding")
    )


def job_queries(spark, folder):
    """The question of each job: the vector whose number is the job's."""
    return stored_queries(spark, folder)


def incoming_queries(spark, folder):
    """Every vector, pulled towards the next one by 0 to 90 percent, is asked again."""
    stored = stored_queries(spark, folder)
    many = stored.agg(F.count("*").alias("n")).scalar()
    follower = stored.select(
        ((F.col("job_id") + many - 1) % many).alias("job_id"), F.col("embedding").alias("pull")
    )
    share = (F.col("job_id") % 10) / 10.0
    mixed = F.zip_with("embedding", "pull", lambda x, y: x + y * share)
    return stored.join(follower, "job_id").select(
        F.col("job_id").alias("query_id"),
        F.concat(F.lit("question "), F.col("job_id").cast("string")).alias("text"),
        mixed.alias("embedding"),
    )
