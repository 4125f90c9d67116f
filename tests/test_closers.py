"""Types that can be closed against a hand-labelled table."""

from __future__ import annotations

from patchlens.operators import closers as CL
from patchlens.operators import pair_rules as PR
from patchlens.plans.workspace import written

FILES = {
    "pkg/store/a.go": "\n".join([
        "package store", "type File struct {", "\tname string", "}",
        "func (f *File) Close() error {", "}",
        "type Log struct {", "\t*File", "\tn int", "}",
        "type Deep struct {", "\tLog // kept", "}",
        "type Plain struct {", "\tfile File", "}",
        "type Source interface {", "\tRead() []byte", "\tClose() error", "}",
        "type Other interface {", "\tRead() []byte", "}",
        "type Std struct {", "\tio.Closer `json:\"-\"`", "}",
        "type Ring struct {", "\t*Loop", "}", "type Loop struct {", "\t*Ring", "}",
        "func NewDeep(p string) (*Deep, error) {", "}", "func NewPlain() Plain {", "}",
        "func named() (p *Plain, err error) {", "}", "func twice() Plain {", "}",
    ]),
    "pkg/store/b.go": "\n".join([
        "package store", "func twice() Deep {", "}", "func use() {",
        "\ta, err := NewDeep(db.Conn(x))", "\tb := Plain{c: db.Conn(x)}", "\tc := &Log{}",
        "\td := new(Ring)", "\te, err := named()", "\tf := twice()", "\tg := unknown(db.Conn(x))",
        "\th := &Std{}", "\ti := Source{}", "\tj := os.File{}", "\tk := &bytes.Buffer{}",
        "\tm, err := NewPlain(net.Dial(x))", "}",
    ]),
    "pkg/other/c.go": "\n".join([
        "package other", "func use() {", "\ta := &store.Deep{}", "\tb := store.NewPlain()",
        "\tc := &File{}", "\td := store.Other{}", "}"]),
}


def test_facts_equal_the_labels(file_lines):
    facts = CL.closer_facts(file_lines(FILES), lambda df: written(df, "types")).collect()
    got = {(r["file"], r["line"]): r["implements_closer"] for r in facts}
    b, c = "pkg/store/b.go", "pkg/other/c.go"
    assert got == {
        (b, 5): True, (b, 6): False, (b, 7): True, (b, 8): False, (b, 9): False, (b, 12): True,
        (b, 13): True, (b, 14): True, (b, 15): False, (b, 16): False,
        (c, 3): True, (c, 4): False, (c, 6): False}
    assert len(facts) == len(got) and {r["idx"] for r in facts} == {0}


def test_values_that_cannot_be_closed_are_cleared(file_lines, found):
    lines = file_lines(FILES)
    facts = written(CL.closer_facts(lines, lambda df: written(df, "types")), "facts")
    plain = {h[2] for h in found(PR.pair_hits(lines, only={"RES-AST-001"}))}
    typed = {h[2] for h in found(PR.pair_hits(lines, only={"RES-AST-001"}, type_facts=facts))}
    assert plain == {5, 6, 11, 16} and typed == {5, 11}
