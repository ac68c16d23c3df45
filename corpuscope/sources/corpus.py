"""Test corpora: views over the driver's tables that give every operator something to find.

The tables hold prose and HTML only, so each document is laid out as a file of a repository
and most documents get a small code snippet in front of their text.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.paths import suffix
from ..session import fixed_rows
from .files import spread

# (number, kind, dir, name, append the document text, content)
SNIPPETS = [
    (0, 0, "src", "util.py", True, "def helper(x):\n    return x\n"),
    (1, 0, "src", "main.py", True, '"""Order service entry point."""\nfrom fastapi import FastAPI\napp = FastAPI()\n@app.get("/orders/list")\ndef list_orders():\n    return []\n@app.get("/health")\ndef health():\n    return {}\napi_key = "fixture-value"\n'),
    (2, 6, "app/controllers", "PetController.java", True, '@RestController\n@RequestMapping("/api/pets")\npublic class PetController {\n  @GetMapping("/list")\n  public List listPets() { return null; }\n  @PostMapping("/add")\n  @Deprecated\n  public Pet addPet() { return null; }\n}\n'),
    (3, 0, "app/entity", "User.java", True, '@Entity\n@Table(name = "users")\npublic class User {\n  private Long id;\n  private String email;\n}\n'),
    (4, 0, "app/model", "Order.kt", True, "data class Order(val id: Long, val total: Double)\n// TODO: add currency\n"),
    (5, 6, "proto", "pets.proto", True, "message Pet { string name = 1; int32 age = 2; }\nservice PetService {\n  rpc GetPet (PetRequest) returns (PetReply)\n}\n"),
    (6, 5, "android", "build.gradle", False, "jcenter()\next.kotlinVersion = \"1.3.21\"\nimplementation 'org.springframework.boot:spring-boot-starter:2.1.4'\nimplementation 'mysql:mysql-connector-java:8.0.1'\njvmTarget = \"1.8\"\n"),
    (7, 5, "server", "pom.xml", False, "<project><dependency><groupId>org.postgresql</groupId><artifactId>postgresql</artifactId><version>42.2.5</version></dependency>\n<dependency><groupId>a.b</groupId><artifactId>c</artifactId><version>${v}</version></dependency></project>\n"),
    (8, 0, "web", "package.json", False, '{"name":"web","description":"shop","dependencies":{"react":"^18.2.0","express":"~4.18.0"},"devDependencies":{"jest":"29.0.0"}}\n'),
    (9, 5, "svc", "requirements.txt", False, "# pinned\nflask==2.0.1\npyjwt>=2.4\nredis\n"),
    (10, 0, "deploy", "Dockerfile", False, "FROM openjdk:17\n"),
    (11, 4, "k8s", "deployment.yaml", False, "apiVersion: apps/v1beta1\nkind: Deployment\n"),
    (12, 4, "ops", "stack.yaml", False, "apiVersion: v1\nkind: Service\n"),
    (13, 1, "android/app", "AndroidManifest.xml", False, '<manifest><uses-permission android:name="android.permission.CAMERA"/></manifest>\n'),
    (14, 2, "ios", "Podfile", False, "platform :ios\n"),
    (15, 2, "ios", "Info.plist", False, "<key>NSCameraUsageDescription</key>\n"),
    (16, 3, "desktop", "App.csproj", False, "<Project/>\n"),
    (17, 7, "web/public", "index.html", True, "<html></html>\n"),
    (18, 8, "docs", "PRIVACY.md", True, "We process personal data under GDPR.\n"),
    (19, 0, "tests", "test_orders.py", True, 'password = "fixture"\nThread.sleep(5)\nassert len(x) > 0\n'),
    (20, 0, "dags", "daily.py", True, 'dag = DAG("daily_load")\nt = PythonOperator(task_id="a")\nspark.read.parquet("s3://b/x.parquet")\nc = KafkaConsumer("t")\n'),
    (21, 0, "dbt/models", "orders.sql", False, "select * from {{ ref('stg_orders') }}\n"),
    (22, 0, "flows", "etl_flow.py", True, "@flow\ndef f(): pass\n@asset\ndef a(): pass\nclass Load(luigi.Task):\n  pass\ndf.dropna()\n"),
    (23, 0, "ml", "train.py", True, 'import torch\nfrom sklearn import metrics\ndf = pd.read_csv("x.csv")\nclass Net(nn.Module):\n  pass\nfor epoch in range(3):\n  loss.backward()\nf1_score(y, p)\ntorch.save(m)\n'),
    (24, 0, "notebooks", "eda.ipynb", False, '{"cells":[{"cell_type":"markdown","source":["LSTM"]},{"cell_type":"code","source":["import xgboost","XGBClassifier()"]}]}\n'),
    (25, 0, "mobile/screens", "HomeScreen.tsx", True, "export default function HomeScreen() { return null }\n"),
    (26, 0, "mobile/ui", "Login.kt", True, "class LoginActivity : AppCompatActivity()\n@Composable fun LoginScreen() {}\n"),
    (27, 0, "gateway", "server.js", True, 'const jwt = require("jsonwebtoken");\napp.use(cors());\nrouter.post("/v1/login", h);\nreq.session.user = 1;\n// FIXME: rate_limit\n'),
    (28, 0, "legacy", "screen.abcml", True, "PROGRAM DIVISION.\n"),
    (29, 3, "desktop/ui", "MainRibbon.xml", False, '<ribbon event="Clicked"/>\n'),
    (30, 0, "auth", "token_service.go", True, 'func main() { r.GET("/token", h) }\n'),
]
SNIPPET_SCHEMA = "s int, kind int, dir string, name string, app boolean, snip string"


def corpus_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table as files of 20 repositories (see FIXTURES.md)."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"), "doc_id")
    i, r = F.col("doc_id"), F.col("doc_id") % 20
    s = (7 * i + F.floor(i / 20)) % 31
    snippets = F.broadcast(fixed_rows(spark, SNIPPETS, SNIPPET_SCHEMA))  # 31 rows, fixed
    kinds = {0: F.lit(True), 1: r % 5 == 0, 2: r % 5 == 1, 3: r % 5 == 2, 4: r % 4 == 1, 5: r % 2 == 0,
             6: r % 3 != 0, 7: r % 2 == 1, 8: r % 7 == 0}
    kind_of = F.create_map(*[F.lit(x) for n, k, *_ in SNIPPETS for x in (n, k)])
    kind = F.element_at(kind_of, s.cast("int"))
    allowed = F.when(kind == 0, (s == 0) | ((r + s) % 3 != 0))
    for k in range(1, 9):
        allowed = allowed.when(kind == k, kinds[k])
    docs = docs.withColumn("s", F.when((i >= 40) & ~allowed, 0).otherwise(s).cast("int"))
    rs = r.cast("string")
    head, second, text = i < 20, i < 40, F.col("text")
    path = (F.when(head & r.isin(4, 14), "main.py").when(head & (r % 5 == 4), "notes.txt")
            .when(head, "README.md").when(second & (r == 19), "todo.txt")
            .when(second & (r % 2 == 0), "package.json").when(second, "pyproject.toml")
            .otherwise(F.concat("dir", F.lit("/d"), i.cast("string"), F.lit("/"), "name")))
    content = (F.when(head & r.isin(4, 14), '"""Fixture service."""\n').when(head & (r % 5 == 4), text)
               .when(head, F.concat(F.when(r % 6 == 0, "Personal data follows GDPR.\n").otherwise(""), text))
               .when(second & (r == 19), text)
               .when(second & (r % 2 == 0), F.concat(F.lit('{"name": "app'), rs, F.lit('", "description": "fixture", "dependencies": {"react": "^18.2.0"}}')))
               .when(second, F.concat(F.lit('name = "app'), rs, F.lit('"\ndescription = "fixture"\n')))
               .otherwise(F.concat("snip", F.when(F.col("app"), text).otherwise(""))))
    # a file that cannot hold prose has the text in a file beside it
    beside = (F.when(head, r.isin(4, 14)).when(second, r != 19).otherwise(~F.col("app")))
    beside_path = F.when(~head & second, F.concat(F.lit("text"), i.cast("string"), F.lit(".txt"))).otherwise(F.concat("dir", F.lit("/d"), i.cast("string"), F.lit("/text.txt")))
    file = lambda p, c: F.struct(p.alias("path"), c.alias("content"))
    both = F.when(beside, F.array(file(path, content), file(beside_path, text))).otherwise(F.array(file(path, content)))
    out = docs.join(snippets, "s").select(F.col("source").alias("repo"), F.explode(both).alias("f")).select("repo", "f.path", "f.content")
    return out.select("repo", "path", suffix(F.col("path")).alias("ext"),
                      F.octet_length("content").cast("long").alias("size"), "content")


def web_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages table as files: host -> repository, URL path -> directory."""
    pages = spread(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id")
    bare = F.regexp_replace("url", r"[?#].*$", "")
    host = F.regexp_extract(bare, r"^[a-z]+://([^/]+)", 1)
    folder = F.regexp_replace(F.regexp_replace(bare, r"^[a-z]+://[^/]+/?", ""), "/+$", "")
    path = F.concat(F.when(folder == "", "").otherwise(F.concat(folder, F.lit("/"))), F.lit("d"),
                    F.col("page_id").cast("string"), F.lit("/index.html"))
    return pages.select(host.alias("repo"), path.alias("path"), F.lit(".html").alias("ext"),
                        F.octet_length("html").cast("long").alias("size"), F.col("html").alias("content"))


def report_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document with sixteen sections per row of documents, with defects to score and repair.

    The whole text is in it, a sixteenth in each section; a missing section lacks its heading only.
    """
    from ..rules.documents import CLARITY, HEADINGS
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"), "doc_id")
    i, text = F.col("doc_id"), F.col("text")
    step = F.floor(F.length("text") / 16).cast("int")
    phrase = F.element_at(F.array(*[F.lit(p) for p in CLARITY]), (F.floor(i / 4) % len(CLARITY) + 1).cast("int"))
    extra = {
        2: F.when(i % 4 == 0, F.concat(F.lit("It is "), phrase, F.lit("\n"))).otherwise(""),
        4: F.when(i % 3 == 0, "").when(i % 3 == 1, "| Role | Task |\n| End User | works |\n").otherwise("| Role | Task |\n|---|---|\n| Billing Manager | pays |\n"),
        5: F.concat(F.lit("FR-1 SHALL run\nFR-12 later\n"), F.when(i % 6 == 0, "FR-999 SHALL vanish\n").otherwise(""),
                    F.when(i % 2 == 0, "Order Search\n").otherwise("dashboard_report\n")),
        6: F.when(i % 5 == 0, "NFR-1 TBD\n").otherwise("NFR-1 within 500 ms\n"),
        10: F.when(i % 4 == 0, "| Host | Docker image |\n").when(i % 4 == 1, "Kubernetes and gRPC\n").when(i % 4 == 2, "GDPR applies to the iOS client\n\n\n\n").otherwise(""),
    }
    body = lambda h: F.substr(text, (h - 1) * step + 1, step) if h < len(HEADINGS) else F.substr(text, (h - 1) * step + 1)
    parts = [F.concat(F.when((i + h) % 17 == 0, "").otherwise(F.concat(F.lit(heading + "\n"), extra.get(h, F.lit("")))), body(h), F.lit("\n"))
             for h, heading in enumerate(HEADINGS, 1)]
    return docs.select(F.concat(F.lit("doc"), i.cast("string")).alias("doc_key"), F.col("source").alias("repo"), F.concat(*parts).alias("text"))


def inferred_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A learned tier made from the corpus: its unknown extensions, plus one curated collision."""
    exts = corpus_files(spark, sf_dir).select("ext").distinct().filter(F.col("ext").isin(".abcml", ".py"))
    return exts.select("ext", F.concat(F.lit("learned_"), F.substring("ext", 2, 100)).alias("language"), F.lit("backend").alias("role"))
