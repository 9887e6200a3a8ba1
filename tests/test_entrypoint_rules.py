"""Each language's entrypoint rules over one file: what they tag, and what they leave alone."""

import pytest

from skein.operators import entrypoints
from skein.sources import ingest

#: file: (language, text, tagged units, units that stay untagged)
CASES = {
    "h.py": ("python", "@app.get('/x')\ndef a(): pass\n@click.command()\ndef b(): pass\n@shared_task\ndef c(): pass\n@cache.getter\ndef d(): pass\n", "a b c", "d"),
    "r.rs": ("rust", '#[no_mangle]\npub fn a() {}\npub extern "C" fn b() {}\n#[get("/x")]\nasync fn c() {}\n#[tokio::main]\nasync fn d() {}\nimpl S { pub fn e(&self) {} }\nfn f() {}\n', "a b c d", "S.e f"),
    "s.sol": ("solidity", "interface I { function a() external; }\ncontract C { function b() public {} function c() internal {} receive() external payable {} function d(uint x) private {} }\n", "C.b C.receive", "I.a C.c C.d"),
    "n.ts": ("typescript", "@Controller('x')\nexport class C {\n  @Get('y')\n  find(id: string): string { return this.own(); }\n  own() { return 1; }\n}\nclass D {\n  @Get('z')\n  lone() { }\n}\nexport const handler = async (e) => { };\n", "C.find handler", "C.own D.lone"),
    "app/api/route.js": ("javascript", "export async function GET(req) { }\nfunction help() { }\n", "GET", "help"),
    "j.java": ("java", '@RestController\nclass C {\n  @GetMapping("/x")\n  public String a(String s) { return s; }\n  @KafkaListener(topics = "t")\n  void b(String s) { }\n  @Override\n  public String c() { return ""; }\n  void doGet(R r) { }\n  void onCreate(B b) { }\n  // @PostMapping\n  void d() { }\n}\n', "C.a C.b C.doGet C.onCreate", "C.c C.d"),
    "k.kt": ("kotlin", 'class C {\n  @PostMapping("/x")\n  fun a(s: String): String { return s }\n  fun b() { }\n  override fun onCreate(b: Bundle) { }\n}\n', "C.a C.onCreate", "C.b"),
    "c.cs": ("c_sharp", '[ApiController]\npublic class C : ControllerBase {\n  [HttpGet("x")]\n  public string A(int a) { return ""; }\n  [Authorize]\n  public string B(int a) { return ""; }\n}\n', "C.A", "C.B"),
    "p.php": ("php", '<?php\nclass A {\n  #[Route("/x")]\n  public function a() { }\n  # a note\n  public function b() { }\n}\n', "A.a", "A.b"),
    "g.go": ("go", 'package p\nfunc A(w http.ResponseWriter, r *http.Request) { }\nfunc set(m *Mux) { m.HandleFunc("/b", b); m.GET("/c", mid, c) }\nfunc b(x T) { }\nfunc c(x T) { }\nfunc d(x T) { }\n', "A b c", "set d"),
    "app/controllers/u.rb": ("ruby", "class U\n  def index\n  end\nend\n", "U.index", ""),
    "w.rb": ("ruby", "class W\n  def perform(x)\n  end\n  def other\n  end\nend\n", "W.perform", "W.other"),
    "e.c": ("c", '__attribute__((visibility("default")))\nint a(void)\n{ return 1; }\n__declspec(dllexport) int b(int x) { return x; }\nstatic int c(void) { return 0; }\n', "a b", "c"),
    "e.cpp": ("cpp", 'extern "C" int a(int x) { return x; }\nint b(int x) { return x; }\n', "a", "b"),
    "o.m": ("objc", "@implementation D\n- (void)application:(id)x { }\n- (void)other:(id)x { }\n@end\n", "D.application", "D.other"),
    "m.swift": ("swift", "@main\nstruct App {\n  func go() { }\n}\nfunc help() { }\n", "App", "App.go help"),
    "d.dart": ("dart", "@pragma('vm:entry-point')\nvoid a() { }\nvoid b() { }\n", "a", "b"),
    "c.cairo": ("cairo", "#[external(v0)]\nfn a(x: felt252) { }\n#[abi(embed_v0)]\nimpl I of T {\n  fn b(self: @S) { }\n}\nfn c() { }\n", "a I.b", "c"),
    "c.circom": ("circom", "template T(n) { signal input a; }\ncomponent main {public [a]} = T(3);\n", "main", "T"),
    "m.masm": ("masm", "export.a\n push.1\nend\nproc.b\nend\nbegin\n exec.a\nend\n", "a begin", "b"),
    "m.move": ("move", "module m::n { public entry fun a() { } entry fun b() { } public(friend) fun c() { } fun d() { } }\n", "m::n.a m::n.b", "m::n.c m::n.d"),
    "t.tact": ("tact", "contract C { receive() { } get fun a(): Int { return 1; } fun b() { } }\n", "C.receive C.a", "C.b"),
    "f.fc": ("func", "() recv_internal(int a) impure {\n}\nint total() method_id {\n}\nint help(int a) {\n}\n", "recv_internal total", "help"),
    "s.sw": ("sway", "abi A {\n fn a();\n}\nimpl A for Contract {\n fn b() { }\n}\nfn c() { }\npub fn d() { }\n", "A.a A@4_0.b d", "c"),
    "h.hs": ("haskell", "module M where\nmain :: IO ()\nmain = f 1\nhelp :: Int -> Int\nhelp x = x\n", "main", "help"),
    "e.erl": ("erlang", "-module(e).\n-export([a/1, b/0]).\na(X) -> b().\nb() -> ok.\nc(X) -> X.\n", "a b", "c"),
    "p.rego": ("rego", "allow if {\n  input.x\n}\nhelper if {\n  input.y\n}\n", "allow", "helper"),
    "z.zig": ("zig", "pub export fn a(x: u32) u32 { return x; }\nexport fn b() void {}\npub fn c() void {}\n", "a b", "c"),
    "v.ak": ("aiken", "validator v {\n  spend(d, r) {\n    True\n  }\n}\nfn spend_help() { 1 }\n", "v.spend", "spend_help"),
    "u.cpp": ("cpp", "int main(int a, char** b) { return 0; }\n", "main", ""),
    "s.proto": ("proto", 'syntax = "proto3";\nservice S {\n  rpc Login (In) returns (In);\n}\nmessage In { string t = 1; }\n', "S.Login", "In"),
    "s.thrift": ("thrift", "service S {\n  bool login(1: i32 a),\n}\nstruct In {\n  1: required string t\n}\n", "S.login", "In"),
    "s.graphql": ("graphql", "schema { query: Root }\ntype Root {\n  user(id: ID!): User\n}\ntype User {\n  id: ID!\n}\n", "Root.user", "User.id"),
}


@pytest.fixture(scope="module")
def tagged(spark):
    graph = entrypoints.detect(ingest.parse_text(spark, {f"{k:02}/{name}": case[:2] for k, (name, case) in enumerate(CASES.items())}))
    rows = graph.nodes.where("kind not in ('module', 'proxy')").join(graph.entrypoints.selectExpr("node_id as id", "trust_level"), "id", "left").select("file_path", "id", "trust_level").collect()
    return {(r["file_path"].split("/", 1)[1], r["id"].split(":", 1)[1] if not r["id"].startswith("ex.") else r["id"]): r["trust_level"] for r in rows}


@pytest.mark.parametrize("name", CASES)
def test_each_language_is_tagged_and_nothing_else(tagged, name):
    _, _, yes, no = CASES[name]
    own = {unit: level for (file, unit), level in tagged.items() if file == name}
    assert set(yes.split()) | set(no.split()) <= set(own), sorted(own)
    assert {u for u in yes.split() if own[u] is None} == set()
    assert {u for u in no.split() if own[u] is not None} == set()


def test_an_override_names_one_node(spark):
    """A '_' or '%' of a name is no wildcard; the id itself wins, else the one unit that the name ends."""
    units = ["a::handleAx", "a::handle_x", "b::twin", "c::twin", "twin::deep", "solo", "z::solo", "pkg.m:go", "q::it's", "x\\y"]
    nodes = spark.createDataFrame([(u, u.split(":")[-1], "function") for u in units], "id string, name string, kind string")
    names = ["handle_x", "handle%", "twin", "solo", "m:go", "it's", "none", "x\\y", "a::handleAx"]
    text = "".join(f"[[entrypoint]]\nnode = '''{n}'''\n" for n in names)
    rules = entrypoints.aimed(nodes, entrypoints.overrides(text))
    assert sorted(r["node_id"] for r in entrypoints.tagged(nodes, rules).collect()) == ["a::handleAx", "a::handle_x", "pkg.m:go", "q::it's", "solo", "x\\y"]
