from __future__ import annotations

from patchlens.operators import line_rules as LR
from patchlens.operators import pair_rules as PR

SECRET = "pass" + "word"


def line_checks(file_lines, found, files, rule):
    return found(LR.line_hits(file_lines(files), only={rule}))


def test_secrets(file_lines, found):
    text = "\n".join([
        f'{SECRET} := "Winter-Storm-1"',
        f'{SECRET} := os.Getenv("Winter-Storm-1")',
        f'{SECRET} := "your-secret-here"',
        f'// {SECRET} := "Winter-Storm-1"',
        f'{SECRET} := "{SECRET}"',
        f'login({SECRET}, "Winter-Storm-1")',
        f'{SECRET} == "Winter-Storm-1"',
        f'X string `json:"{SECRET}-Winter"`',
        f'{SECRET} = "${{VAULT_ENTRY}}"',
        f"{SECRET} = 'Winter-Storm-1'",
    ])
    got = line_checks(file_lines, found, {"a.py": text}, "SEC-AST-001")
    assert got == [("secret_assigned", "a.py", 1), ("secret_passed", "a.py", 6)]


def test_credential_shapes(file_lines, found):
    samples = {
        "aws": "AK" + "IA" + "Q7RZ" * 4, "github": "gh" + "p_" + "a" * 36, "jwt": "ey" + "J" + "a" * 20 + ".b.c",
        "slack": "xo" + "xb-" + "1" * 12, "stripe": "sk" + "_live_" + "1" * 20,
        "gitlab": "gl" + "pat-" + "1" * 20, "google": "AI" + "za" + "1" * 35, "npm": "np" + "m_" + "1" * 36,
        "sendgrid": "S" + "G." + "a" * 20 + "." + "b" * 20, "private_key": "-----BEGIN RSA PRIVATE " + "KEY-----",
        "database": "mysql://u:" + "p1@h/db", "url": "https://u:" + "p1@h/x", "bearer": "Bear" + "er " + "a1" * 13,
    }
    none = ["https://h/a@b:c", "Bearer " + "your" * 8, "AK" + "IA" + "lower" * 4, "mysql://h/db"]
    text = "\n".join([f'v("{s}")' for s in [*samples.values(), *none]])
    got = line_checks(file_lines, found, {"a.js": text}, "SEC-AST-002")
    assert got == sorted(("leak_" + k, "a.js", i + 1) for i, k in enumerate(samples))


def test_configuration(file_lines, found):
    text = "\n".join([
        f"DB_{SECRET.upper()}=winter-Storm", "api_key: ${KEY}", "url=postgres://u:pw@h/d",
        "token_ttl=360000", "token: a.b.c", f'{SECRET}: "quoted-value"', "# token=winter-Storm",
        "token: short", "secret: call(me)",
    ])
    want = [("config_secret", ".env", 1), ("config_url", ".env", 3)]
    assert line_checks(file_lines, found, {".env": text}, "SEC-GEN-001") == want
    assert line_checks(file_lines, found, {"x.py": text, "x.go": text}, "SEC-GEN-001") == []


def test_errors(file_lines, found):
    text = "\n".join([
        "_ = run(a)", "v, _ := fetch(k)", "_, ok := cache[k]", "n, _ := v.(string)",
        "_, err = f(x)", "var _ I = (*T)(nil)", "_ = f.Close()", 'panic("x")', "log.Fatal(err)",
        "for _, v := range f() {", "_ = x", "// _ = run(a)", "v, _ := w.Write(b)",
    ])
    got = line_checks(file_lines, found, {"a.go": text, "b_test.go": text}, "ERR-AST-001")
    assert got == [
        ("discard_all", "a.go", 1), ("discard_final", "a.go", 2), ("log_fatal", "a.go", 9),
        ("panic", "a.go", 8),
    ]
    main = {"tool.go": "package main\nlog.Fatal(err)", "cmd/x.go": "log.Fatal(err)", "m.md": text}
    assert line_checks(file_lines, found, main, "ERR-AST-001") == []


def test_type_facts_decide_discards(spark, file_lines, found):
    lines = file_lines({"a.go": "a, _, _ := f(x)\nb, _ := g(x)\n_, c := h(x)\nd, _ := i(x)"})
    facts = spark.createDataFrame(
        [("t", "a.go", 2, 1, False), ("t", "a.go", 3, 0, True), ("t", "a.go", 1, 1, False)],
        "task_id string, file string, line int, idx int, is_error boolean",
    )
    got = found(LR.line_hits(lines, only={"ERR-AST-001"}, type_facts=facts))
    assert got == [
        ("discard_final", "a.go", 1), ("discard_final", "a.go", 4), ("discard_typed", "a.go", 3)
    ]


def test_injection(file_lines, found):
    sql = "\n".join([
        'q := "SELECT a FROM t WHERE id=" + id', 'q := "SELECT a FROM t WHERE id=?" + x',
        'q := fmt.Sprintf("delete from t where a=%s", x)', 'q := "SELECT a FROM t"',
        '// q := "SELECT a FROM t" + id', 'q := "please select from" + menu',
    ])
    got = line_checks(file_lines, found, {"a.go": sql}, "SEC-AST-003")
    assert [g[2] for g in got] == [1, 3, 6]
    calls = "\n".join([
        'exec.Command(name, "-v")', 'exec.Command("sh", "-c", s)', 'exec.Command("git", s)',
        'exec.Command("sh", "-c", "a, b)")', 'exec.Command("bash", "-c", "echo " + s)',
        'exec.CommandContext(ctx, "ls")', 'syscall.Exec("/bin/ls", args, env)',
        'syscall.Exec("/bin/ls", "a")', 'exec.Command("sh", f("x", [2]int{1, 2}))',
    ])
    got = line_checks(file_lines, found, {"a.go": calls}, "SEC-AST-004")
    assert [g[2] for g in got] == [1, 2, 5, 6, 7, 9]


def test_single_line_rules(file_lines, found):
    text = "\n".join([
        "c := tls.Config{InsecureSkipVerify: true}", "c := tls.Config{InsecureSkipVerify: false}",
        "// InsecureSkipVerify: true", "t := time.Tick(d)", "ctx, _ := context.WithCancel(c)",
    ])
    hits = found(LR.line_hits(file_lines({"a.go": text, "a.md": text})))
    assert hits == [
        ("cancel_discarded", "a.go", 5), ("discard_final", "a.go", 5), ("time_tick", "a.go", 4),
        ("tls_off", "a.go", 1),
    ]


def test_defer_in_loops(file_lines, patch_lines, found):
    text = "\n".join([
        "for a {", "defer x()", "go func() {", "defer y()", "}()", "}", "defer z()",
        "for b {", "if c {", "defer w()", "}", "}",
    ])
    got = line_checks(file_lines, found, {"a.go": text}, "RES-AST-002")
    # Line 10 lies deeper than the earlier goroutine, which still exempts it.
    assert [g[2] for g in got] == [2]
    patch = "--- a/a.go\n+++ b/a.go\n@@ -1,2 +7,4 @@\n ctx\n+for a {\n-old {\n+\tdefer x()\n+}\n"
    assert [g[2] for g in found(LR.line_hits(patch_lines(patch)))] == [9]


def pairs(file_lines, found, files, rule):
    return [(f, n) for _, f, n in found(PR.pair_hits(file_lines(files), only={rule}))]


def test_resources(file_lines, found):
    files = {
        "open.go": "f, err := os.Open(p)", "closed.go": "f, err := os.Open(p)\ndefer f.Close()",
        "two.go": "f := os.Open(p)\ng := os.Open(q)\ng.Close()",
        "moved.go": "f := os.Open(p)\nreturn f, nil", "ping.go": "d := sql.Open(p)\nreturn d.Ping()",
        "suffix.go": "f := os.Open(p)\nbuf.Close()", "body.go": "r := http.Get(u)\nr.Body.Close()",
        "nobody.go": "r := http.Get(u)\nr.Close()", "doc.md": "f := os.Open(p)",
        "note.go": "// f := os.Open(p)",
    }
    got = pairs(file_lines, found, files, "RES-AST-001")
    assert got == [("nobody.go", 1), ("open.go", 1), ("ping.go", 1), ("two.go", 1)]


def test_long_names_match_by_their_whole_ending(file_lines, found):
    name, other = "h" * 80, "g" + "h" * 79
    files = {
        "same.go": f"{name} := os.Open(p)\n{name}.Close()",
        "ending.go": f"{name} := os.Open(p)\nmy{name}.Close()",
        "other.go": f"{name} := os.Open(p)\n{other}.Close()",
    }
    assert pairs(file_lines, found, files, "RES-AST-001") == [("other.go", 1)]


def test_closers_in_other_hunks(patch_lines, found):
    text = (
        "--- a/a.go\n+++ b/a.go\n@@ -1,1 +1,2 @@\n x\n+f := os.Open(p)\n"
        "@@ -9,1 +10,1 @@\n defer f.Close()\n"
    )
    assert found(PR.pair_hits(patch_lines(text), only={"RES-AST-001"})) == []


def test_other_pairs(file_lines, found):
    assert pairs(file_lines, found, {
        "a.sql": "x.Begin(", "b.go": "x.BeginTx(c)\ny.Rollback()", "c.go": "// x.Begin("
    }, "DB-AST-001") == [("a.sql", 1)]
    assert pairs(file_lines, found, {
        "a.go": "ctx, stop := context.WithCancel(c)",
        "b.go": "ctx, stop := context.WithCancel(c)\ndefer stop()",
        "c.go": "ctx, s.stop = context.WithTimeout(c, d)\nme.s.stop ()",
        "d.go": "ctx, stop := context.WithCancel(c)\nxstop()",
        "e.go": "ctx, stop := context.WithCancel(c)\nuse(stop)",
    }, "CTX-AST-001") == [("a.go", 1), ("d.go", 1), ("e.go", 1)]
    assert pairs(file_lines, found, {
        "a.go": "mu.Lock()", "b.go": "mu.Lock()\ns.mu.Unlock()", "c.go": "s.mu.Lock()\nmu.Unlock()",
        "d.go": "mu.RLock()",
    }, "CON-AST-001") == [("a.go", 1), ("c.go", 1)]
    assert pairs(file_lines, found, {
        "a.go": "t := time.NewTimer(d)", "b.go": "t := time.NewTicker(d)\ns.t.Stop()",
        "c.go": "t := time.NewTimer(d)\nat.Stop()", "d.go": "_ = time.NewTimer(d)",
    }, "RES-AST-002") == [("a.go", 1), ("c.go", 1)]
    assert pairs(file_lines, found, {
        "a.go": "rows, err := db.Query(q)", "b.go": "rows, err = db.QueryContext(c, q)\nrows.Err()",
        "c.go": "row, err := db.Query(q)",
    }, "DB-AST-002") == [("a.go", 1)]


def test_goroutines(file_lines, patch_lines, found):
    files = {
        "a.go": "go worker(q)", "b.go": "go p.Send(x)", "c.go": "go worker(q)\nselect {",
        "d.go": "go worker(Ctx)", "e.go": "go func() {\nx()\n}()",
        "f.go": "go func() {\nfor {\n}\n}()", "go.mod": "go 1.21", "g.go": '// go worker(q)\ns := "go"',
    }
    got = found(PR.goroutine_hits(file_lines(files)))
    assert got == [
        ("goroutine_leak", "a.go", 1), ("goroutine_leak", "f.go", 1),
        ("goroutine_qualified", "b.go", 1),
    ]
    text = (
        "--- a/a.go\n+++ b/a.go\n@@ -1,1 +1,1 @@\n+go run(q)\n@@ -9,1 +9,1 @@\n+<-done\n"
    )
    assert [g[2] for g in found(PR.goroutine_hits(patch_lines(text)))] == [1]


def test_swallowed_errors(file_lines, found):
    files = {
        "a.go": "if err != nil {\nlog()\nreturn nil\n}\nif err != nil {\nreturn nil\n}",
        "b.go": "if err != nil {\nreturn err\nreturn nil",
        "c.go": "if err != nil {\n1\n2\n3\n4\nreturn nil", "d.go": "if err != nil {\n1\n2\n3\nreturn nil",
    }
    got = found(PR.swallowed_error_hits(file_lines(files)))
    assert [(f, n) for _, f, n in got] == [("a.go", 1), ("d.go", 1)]


def test_context_roots(file_lines, found):
    files = {
        "a.go": "func A(ctx context.Context) {\nx := context.Background()\n}\nfunc B() {\ny := context.TODO()",
        "b.go": "func C() context.Context {\nx := context.Background()",
        "c.go": "func (s *S) D(ctx context.Context) {\n// context.TODO()\nz(context.TODO())",
        "d_test.go": "func E(ctx context.Context) {\ncontext.TODO()",
        "e.go": "func main(ctx context.Context) {\ncontext.TODO()",
    }
    got = found(PR.context_root_hits(file_lines(files)))
    # Only the text up to the first closing bracket counts: a receiver hides the parameters.
    assert [(f, n) for _, f, n in got] == [("a.go", 2)]


def test_context_roots_over_many_chunks(file_lines, found, monkeypatch):
    text = ["func A(ctx context.Context) {"] + ["x"] * 50 + ["context.TODO()"] + ["func B() {"]
    text += ["y"] * 30 + ["context.TODO()"] + ["func C(c context.Context) {", "context.TODO()"]
    lines = file_lines({"a.go": "\n".join(text)})
    whole = found(PR.context_root_hits(lines))
    monkeypatch.setattr(PR, "CHUNK", 4)
    assert found(PR.context_root_hits(lines)) == whole
    assert [n for _, _, n in whole] == [52, 86]


def test_missing_tests(file_lines, found):
    files = {
        "a.go": "func Load(p string) {\nfunc Save() {\nfunc Drop() {\nfunc Keep() {\nfunc String() string {\n"
                "func (t T) Do() {\nfunc lower() {\nfunc Copy() {\nx := Copy",
        "a_test.go": "func TestLoad(t *testing.T) {\ndoLoad()\n}\nfunc TestSave_empty(t *testing.T) {\n"
                     "// Drop()\nuse(Keep)",
    }
    got = found(PR.missing_test_hits(file_lines(files)))
    assert [(f, n) for _, f, n in got] == [("a.go", 3)]
    # A test function without any working line does not count.
    skipped = {"a.go": "func Load() {", "a_test.go": 'func TestLoad(t) { t.Skip("doLoad(") }'}
    assert [g[2] for g in found(PR.missing_test_hits(file_lines(skipped)))] == [1]


def test_large_deletes(patch_lines, found):
    body = "".join(f"-l{i}\n" for i in range(30))
    text = (
        f"--- a/x.md\n+++ b/x.md\n@@ -1,30 +1,1 @@\n{body}+first\n@@ -50,1 +21,3 @@\n ctx\n+second\n+third\n"
        f"--- a/y.md\n+++ b/y.md\n@@ -4,30 +0,0 @@\n{body}"
        "--- a/z.md\n+++ b/z.md\n@@ -1,1 +1,1 @@\n-a\n+b\n"
    )
    got = found(PR.large_delete_hits(patch_lines(text)))
    assert got == [("large_delete", "x.md", 22), ("large_delete", "y.md", 4)]


def test_names_with_other_letters_are_found_in_tests(spark, file_lines, found):
    from patchlens.operators.pair_rules import missing_test_hits

    lines = file_lines({
        "a.go": "package a\nfunc LoadÜberX() int {\n\treturn 1\n}\nfunc OpenÜber2() int {\n\treturn 2\n}\n",
        "a_test.go": "package a\nfunc TestIt(t *testing.T) {\n\tx := LoadÜberX()\n}\n",
    })
    assert [r[2] for r in found(missing_test_hits(lines))] == [5]
