from tessera.sources import syntax as S

GO = 'package p\n\nfunc a() {\n\ts := "}"\n}\n\nfunc (r *R) b(x map[string]int) (int, error) {\n\tfor i := range x {\n\t}\n\tgo func() {\n\t}()\n}\n\ntype (\n\tT struct {\n\t\tx int\n\t}\n)\ntype I interface {\n\tm()\n}\nvar v = struct{ a int }{1}\nvar r = `\\`\nfunc last() { open('
TS = 'export class A extends B {\n  private x = 1;\n  constructor(a: number) {\n    if (a) { f({ b: 1 }); }\n  }\n  get y(): string { return `}${this.x}`; }\n}\nconst f = async (a) => {\n  return a;\n};\nfunction g<T>(a: T) {\n}\nlet h = function () {};\ninterface I { m(): void }\nitems.map(x => { return x; });\nif (a) { b() }\n'
RUST = "impl<'a> T<'a> {\n    pub fn new(x: &'a str) -> Self {\n        let c = '{';\n        Self { x }\n    }\n}\nstruct P { x: i32 }\nfn m() { let s = r#\"fn no() {\"#; match s { _ => {} } }\n"
CS = 'namespace N {\n  public class C : B {\n    public int M(int a) {\n      if (a > 0) { return 1; }\n      return 0;\n    }\n  }\n}\n'
PY = "class A:\n    @x\n    def f(self):\n        '''def no():'''\n        return 1\n\nasync def g(): pass\n"


def test_braces():
    assert sorted(S.braced(GO, "go")) == sorted([("function", "a", 3, 5), ("function", "b", 7, 12), ("function", "", 10, 11), ("type", "I", 19, 21), ("function", "last", 24, 24)])
    assert sorted(S.braced(TS, "typescript")) == sorted([("type", "A", 1, 7), ("function", "constructor", 3, 5), ("function", "y", 6, 6), ("function", "f", 8, 10), ("function", "g", 11, 12), ("function", "h", 13, 13), ("type", "I", 14, 14), ("function", "", 15, 15)])
    assert sorted(S.braced(RUST, "rust")) == sorted([("function", "new", 2, 5), ("type", "P", 7, 7), ("function", "m", 8, 8)])
    assert sorted(S.braced(CS, "dotnet")) == sorted([("type", "C", 2, 7), ("function", "M", 3, 6)])


def test_python():
    assert sorted(S.python_ranges(PY)) == [("function", "f", 3, 5), ("function", "g", 7, 7), ("type", "A", 1, 5)]
    assert [r[0] for r in S.python_ranges("def (")] == ["problem"]


def test_lengths(spark):
    df = spark.createDataFrame([("a.py", PY), ("b.py", "def ("), ("c.go", GO), ("d.txt", "func x() {}"), ("e.go", None)], "file string, text string")
    found = S.ranges(df)
    owned = df.selectExpr("file", "if(file = 'c.go', 'n', 'm') as module")
    got = {r.module: tuple(r)[1:] for r in S.lengths(found, owned, over=3).collect()}
    assert got == {"m": (4, 3, 2, 1, 3, 3, 0), "n": (1, 1, 4, 2, 6, 6, 1)}
