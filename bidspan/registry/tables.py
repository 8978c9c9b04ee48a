"""The catalogue's tables derived by Spark from the given TPC-H-like tables.

Every derivation is a projection or join over whole tables, so queries grow with
their input. Missing dates, unknown values and incoherent rows come from fixed
rules on keys, so both engines see the same edge cases.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from bidspan.functions import classify, scoring
from bidspan.functions import text as tx
from bidspan.operators import projections, windows
from bidspan.session import configure
from bidspan.sources import readers

NOW = "1998-09-02 12:00:00"
TODAY = "1998-09-02"
EVENTS_NOW = "2024-01-20 12:00:00"
EVENTS_TODAY = "2024-01-20"
MODEL = "m64"

# Objects of purchase, picked by key; both spellings of accents on purpose.
OBJECTS = [
    "Pavimentação asfáltica de vias urbanas", "Drenagem e galeria pluvial no bairro central",
    "Urbanização da praça municipal", "Manutenção predial preventiva das escolas",
    "Elaboração de projeto executivo de engenharia", "Reforma e ampliação do hospital regional",
    "Construção de escola com cobertura metálica", "Aquisição de material de escritório",
    "Serviço de vigilância patrimonial", "CONSTRUCAO DE QUADRA POLIESPORTIVA",
    "Recapeamento e infraestrutura elétrica", "Fornecimento de merenda escolar",
    "Terraplenagem e concreto para acesso viário", "Locação de veículos",
    "Instalação hidráulica e elétrica em unidade de saúde", "Laudo técnico de obra de contenção de encosta",
]
DOC_NAMES = [
    "Edital de licitação.pdf", '"Planilha orçamentária.xlsx"', "Projeto básico  executivo.pdf",
    "Termo_de_Referência.pdf", "Minuta do contrato.pdf", "orÃ§amento sintÃ©tico.xls",
    "Memorial descritivo.pdf", "Recibo de entrega.pdf", "Aviso de contratação direta.pdf", "foto.jpg",
    "prancha 01.dwg", "certidão negativa.pdf",
]
DOC_LABELS = ["Outros Documentos", "Edital", "Projeto Básico", "Termo de Referência"]
TEAM_STATUSES = ["nova", "em_analise", "interessante", "descartada", "proposta_enviada"]
STATUS_NAMES = ["Divulgada no PNCP", "Revogada", "Anulada", "Suspensa"]


def pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def span(days: Column | int = 0, hours: Column | int = 0) -> Column:
    as_col = lambda v: v.cast("int") if isinstance(v, Column) else F.lit(v)
    return F.make_dt_interval(as_col(days), as_col(hours))


_SCHEMAS: dict[str, StructType] = {}


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = configure(spark), sf_dir.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        """A given table; its schema is read from the files once per process.

        Splits are the reader's. ``spark.bidspan.deal`` lets a caller name tables
        whose rows are dealt over all cores first, for files of one row group.
        """
        path = f"{self.dir}/{name}.parquet"
        if path not in _SCHEMAS:
            _SCHEMAS[path] = self.spark.read.parquet(path).schema
        df = self.spark.read.schema(_SCHEMAS[path]).parquet(path)
        dealt = self.spark.conf.get("spark.bidspan.deal", "").split(",")
        return df.repartition(self.spark.sparkContext.defaultParallelism, df.columns[0]) if name in dealt else df

    @property
    def now(self) -> Column:
        return F.lit(NOW).cast("timestamp")

    @property
    def events_now(self) -> Column:
        return F.lit(EVENTS_NOW).cast("timestamp")

    # ------------------------------------------------------------- catalogue

    @cached_property
    def bid_core(self) -> DataFrame:
        """Bids from ``orders`` alone; no place columns, no join."""
        k, p = F.col("o_orderkey"), F.col("o_orderpriority")
        o = self.raw("orders")
        published = F.col("o_orderdate").cast("timestamp") + span(hours=k % 24)
        status = (
            F.when(k % 97 == 0, F.lit(None))
            .when(F.col("o_orderstatus") == "P", 2 + k % 3)
            .when((F.col("o_orderstatus") == "F") & (k % 4 == 0), 4)
            .otherwise(1)
            .cast("int")
        )
        opens = published + span(days=k % 10)
        closes = F.when(k % 71 == 0, published - span(days=5)).otherwise(opens + span(days=1 + k % 45))
        base = o.select(
            k.alias("bid_id"),
            F.col("o_custkey").alias("custkey"),
            F.lpad(F.col("o_custkey").cast("string"), 14, "0").alias("cnpj"),
            F.when(k % 29 != 0, F.year("o_orderdate")).alias("year"),
            (k % 1000 + 1).cast("int").alias("seq"),
            F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("agency"),
            F.concat(pick(OBJECTS, k % 16), F.lit(" - lote "), (k % 97).cast("string"), F.lit(" "), p).alias("object"),
            F.when(k % 33 == 0, F.lit(None)).when(k % 31 == 0, "null").otherwise(F.concat(F.lit("PROC-"), (k % 500).cast("string"))).alias("process"),
            (k % 15 + 1).cast("int").alias("modality_id"),
            status.alias("status_id"),
            F.when(k % 3 == 0, True).when(k % 3 == 1, False).alias("srp"),
            F.when(k % 11 != 0, F.col("o_totalprice").cast("decimal(18,4)")).alias("value"),
            published.alias("published_at"),
            F.when(k % 53 != 0, opens).alias("opens_at"),
            F.when(k % 37 != 0, closes).alias("closes_at"),
            F.when(k % 41 != 0, published + span(days=k % 7)).alias("updated_at_source"),
            pick(TEAM_STATUSES, k % 5).alias("team_status"),
            (p.startswith("1") | p.startswith("2")).alias("priority"),
            F.when(k % 13 == 0, F.concat(F.lit("nota "), k.cast("string"))).otherwise("").alias("notes"),
            (published + span(hours=1)).alias("created_at"),
            (published + span(hours=1)).alias("changed_at"),
            (published + span(hours=3)).alias("synced_at"),
            F.when(k % 2 == 0, published + span(hours=1)).alias("seen_at"),
            F.when(k % 7 == 0, published + span(days=3)).alias("accessed_at"),
        )
        base = base.withColumns(
            {
                "control_no": F.concat_ws("-", "cnpj", F.lit("1"), F.col("bid_id").cast("string")),
                "modality": readers.modality_name(F.col("modality_id")),
                "status_name": F.when(F.col("status_id").isNotNull(), pick(STATUS_NAMES, F.col("status_id") - 1)),
                "category": classify.category(F.col("object")),
                "portal_url": tx.portal_url(F.col("cnpj"), F.col("year"), F.col("seq")),
            }
        )
        return base.withColumn("score", scoring.score(F.col("object"), F.col("modality"), F.col("value"), F.col("category")))

    @cached_property
    def bids(self) -> DataFrame:
        """Bids with their place: agency → city → state."""
        k = F.col("bid_id")
        place = (
            self.raw("customer").select(F.col("c_custkey").alias("custkey"), "c_nationkey", F.col("c_mktsegment").alias("unit_name"))
            .join(self.raw("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .join(self.raw("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select("custkey", "unit_name", F.col("n_name").alias("_city"), F.col("r_name").alias("_uf"), F.lpad(F.col("n_nationkey").cast("string"), 7, "0").alias("_code"))
        )
        joined = self.bid_core.join(place, "custkey").drop("custkey")
        placed = joined.withColumns(
            {
                "city": F.col("_city"),
                "uf": F.when(k % 43 != 0, F.col("_uf")),
                "city_code": F.when(k % 47 != 0, F.col("_code")),
            }
        ).drop("_city", "_uf", "_code")
        return placed.withColumn("source_hash", F.md5(F.concat_ws("|", "control_no", "object", F.coalesce(F.col("status_id").cast("string"), F.lit("-")))))

    @cached_property
    def cities(self) -> DataFrame:
        k = F.col("n_nationkey")
        joined = self.raw("nation").join(self.raw("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        return joined.select(
            F.lpad(k.cast("string"), 7, "0").alias("city_code"), F.col("n_name").alias("city"), F.col("r_name").alias("uf"),
            (k * 1.5 - 33.0).cast("double").alias("lat"), ((k * 7) % 35 - 70.0).cast("double").alias("lon"),
        )

    # ------------------------------------------------------- documents, items

    @cached_property
    def raw_docs(self) -> DataFrame:
        """Document metadata as received: repeated sequences included."""
        q = F.col("l_quantity").cast("long")
        label = F.when(F.col("l_suppkey") % 5 != 4, pick(DOC_LABELS, F.col("l_suppkey") % 5))
        name = pick(DOC_NAMES, F.col("l_partkey") % 12)
        url = F.concat(F.lit("https://files.example:1401/"), F.col("l_orderkey").cast("string"), F.lit("/"), F.col("l_linenumber").cast("string"))
        return self.raw("lineitem").select(
            F.col("l_orderkey").alias("bid_id"), F.col("l_linenumber").alias("seq"),
            label.alias("source_type"), name.alias("title"), F.when(q % 13 != 0, url).alias("url"),
            F.col("l_shipdate").cast("timestamp").alias("published_at"), (q % 10 != 0).alias("active"),
            F.struct(F.col("l_shipdate").cast("timestamp").alias("d"), "l_partkey", "l_suppkey", F.col("l_extendedprice").alias("p")).alias("version"),
        )

    @cached_property
    def docs(self) -> DataFrame:
        """Documents, unique on (bid_id, seq), classified."""
        kept = windows.dedup_documents(self.raw_docs, F.col("version")).drop("version")
        return kept.select(
            "bid_id", "seq", (F.col("bid_id") * 100 + F.col("seq")).alias("doc_id"),
            classify.document_type(F.col("source_type"), F.col("title")).alias("doc_type"),
            "source_type", tx.clean_title(F.col("title")).alias("name"), tx.strip_port(F.col("url")).alias("url"), "published_at", "active",
        )

    @cached_property
    def titled_docs(self) -> DataFrame:
        """The same rows as ``docs`` for whole-table work: titles and labels are classified once per distinct pair."""
        kept = windows.dedup_documents(self.raw_docs, F.col("version")).drop("version")
        rules = {"doc_type": classify.document_type(F.col("source_type"), F.col("title")), "name": tx.clean_title(F.col("title"))}
        return projections.per_distinct(kept, self.raw_docs, ["source_type", "title"], rules).select(
            "bid_id", "seq", (F.col("bid_id") * 100 + F.col("seq")).alias("doc_id"), "doc_type",
            "source_type", "name", tx.strip_port(F.col("url")).alias("url"), "published_at", "active",
        )

    @cached_property
    def items(self) -> DataFrame:
        """Line items with their part's description."""
        line, part = self.raw("lineitem"), self.raw("part")
        joined = line.join(part, F.col("l_partkey") == F.col("p_partkey"))
        flag = F.col("l_returnflag")
        return joined.select(
            F.col("l_orderkey").alias("bid_id"), F.col("l_linenumber").alias("number"), F.col("p_name").alias("description"),
            F.when(F.col("p_size") % 2 == 0, "M").otherwise("S").alias("kind"), F.col("p_type").alias("item_category"), F.col("p_brand").alias("code"),
            F.col("l_quantity").alias("quantity"), F.lit("un").alias("unit"),
            (F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100 + 0.5) / 100).alias("unit_price"), F.col("l_extendedprice").alias("total"),
            F.when(F.col("l_suppkey") % 3 == 0, "Participação exclusiva ME/EPP").when(F.col("l_suppkey") % 3 == 1, "Cota reservada ME/EPP").alias("benefit_name"),
            F.when(flag == "A", "Homologado").when(flag == "N", "Em andamento").alias("status_name"),
            (F.col("l_linestatus") == "F").alias("has_result"), F.col("l_partkey").alias("partkey"), F.col("l_suppkey").alias("suppkey"),
        )

    @cached_property
    def doc_state(self) -> DataFrame:
        """Document collection state; one bid in six has no row yet."""
        k = F.col("o_orderkey")
        state = pick(["pendente", "coletando", "completo", "erro", "completo"], k % 5)
        at = F.lit(NOW).cast("timestamp") - span(hours=k % 12)
        return self.raw("orders").filter(k % 6 != 0).select(k.alias("bid_id"), state.alias("state"), at.alias("changed_at"), F.lit(None).cast("string").alias("error"))

    # ------------------------------------------------ files, vectors, chunks

    @cached_property
    def files(self) -> DataFrame:
        """Text extraction state per stored file; texts are the given documents, whole."""
        k = F.col("doc_id")
        state = pick(["pendente", "erro", "extraido", "extraido", "extraido", "sem_texto", "baixando"], k % 7)
        return self.raw("documents").select(
            "doc_id", F.floor(k / 3).alias("bid_id"), (k % 3 + 1).cast("int").alias("seq"), state.alias("state"),
            (F.col("n_chars") * 2).alias("bytes"), F.sha2("text", 256).alias("sha256"), (k % 9).cast("int").alias("pages"),
            F.col("n_chars").alias("chars"), "text", "lang",
            (F.lit(NOW).cast("timestamp") - span(hours=k % 20)).alias("updated_at"),
            (k % 8 != 0).alias("active"), F.when(k % 10 != 0, F.concat(F.lit("u/"), k.cast("string"))).alias("url"),
            pick(["edital", "anexo", "outro", "projeto", "orcamento"], k % 5).alias("doc_type"),
            F.concat(F.lit("arquivo "), k.cast("string")).alias("name"),
        )

    @cached_property
    def vectors(self) -> DataFrame:
        v = F.col("vec_id")
        return self.raw("embeddings").select(
            v.alias("bid_id"), "embedding", "label", F.when(v % 10 == 9, "antigo").otherwise(MODEL).alias("model"),
            F.concat(F.lit("h"), (v % 4).cast("string")).alias("source_hash"),
        )

    @cached_property
    def chunks(self) -> DataFrame:
        """Chunk vectors with the text of the document they belong to."""
        v = F.col("vec_id")
        vec = self.raw("embeddings").select(
            v.alias("chunk_id"), v.alias("doc_id"), F.floor(v / 3).alias("bid_id"), (v % 3).cast("int").alias("ord"), "embedding", "label",
            F.when(v % 10 == 9, "antigo").otherwise(MODEL).alias("model"),
        )
        text = self.raw("documents").select("doc_id", "text")
        stale = F.when(F.col("chunk_id") % 5 == 0, "stale").otherwise(F.md5("text"))
        return vec.join(text, "doc_id").withColumn("source_hash", stale)

    @cached_property
    def themes(self) -> DataFrame:
        """Query vectors: the mean vector of each label."""
        parts = self.raw("embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
        means = parts.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
        packed = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("p"))
        return packed.select(F.col("label").cast("long").alias("query_id"), F.transform("p", lambda s: s["x"]).alias("embedding"))

    # --------------------------------------------------- jobs, calls, segments

    @cached_property
    def calls(self) -> DataFrame:
        """Source API calls from ``events``: one job per user, errors by kind."""
        k = F.get_json_object("props", "$.k").cast("int")
        failed = F.col("event_type") == "error"
        kind = lambda i: (failed & (k % 4 == i)).cast("long")
        return self.raw("events").select(
            "event_id", F.col("user_id").alias("job_id"), F.col("ts").cast("timestamp").alias("ts"), "event_type", (~failed).alias("ok"), k.alias("k"),
            F.round(F.col("value") * 10).cast("long").alias("latency_ms"),
            kind(0).alias("timeouts"), kind(1).alias("e429"), kind(2).alias("e5xx"), kind(3).alias("other"),
        )

    @cached_property
    def jobs(self) -> DataFrame:
        """One sync job per user of the event stream."""
        job = F.col("job_id")
        return self.calls.groupBy("job_id").agg(
            F.min("ts").alias("started_at"), F.max("ts").alias("_last"), F.count_if(F.col("event_type") == "signup").alias("total_new"),
            F.count_if(F.col("event_type") == "purchase").alias("total_updated"),
        ).select(
            "job_id", "started_at", F.when(job % 6 != 0, F.col("_last")).alias("finished_at"), "total_new", "total_updated",
            pick(["concluido", "concluido_com_erros", "falhou", "em_andamento"], job % 4).alias("status"),
            F.when(job % 2 == 0, "descoberta").otherwise("incremental").alias("kind"),
        )

    @cached_property
    def segments(self) -> DataFrame:
        """Page checkpoints, one per call."""
        day = F.to_date("ts")
        k, e = F.col("k"), F.col("event_id")
        return self.calls.select(
            e.alias("segment_id"), "job_id", F.col("event_type").alias("uf"), (k % 15 + 1).alias("modality_id"),
            F.date_sub(day, (k % 7)).alias("from_date"), day.alias("to_date"),
            F.when(k % 3 != 0, "concluido").when(e % 50 == 7, "falhou").when(e % 10 == 9, "pendente").when(e % 50 == 11, "executando").otherwise("concluido").alias("status"),
            (e % 3).cast("int").alias("priority"), (k % 10).cast("long").alias("pages_applied"), F.when(k % 7 != 0, (k % 12).cast("long")).alias("total_pages"),
            F.col("ts").alias("updated_at"), F.when(e % 4 == 1, F.col("ts") + span(days=1)).alias("retry_at"),
        )

    @cached_property
    def frontier(self) -> DataFrame:
        """Closed-date frontier per (uf, modality); some partitions were never covered."""
        return self.segments.groupBy("uf", "modality_id").agg(F.max("to_date").alias("_d")).select(
            "uf", "modality_id", F.when(F.col("modality_id") % 6 != 0, F.date_sub("_d", 20)).alias("last_closed_date")
        )

    # -------------------------------------------------- shortlist, log, answers

    @cached_property
    def shortlist(self) -> DataFrame:
        return self.raw("conversations").filter("role = 'user'").select(F.col("conv_id").alias("bid_id")).distinct()

    @cached_property
    def history(self) -> DataFrame:
        """Event log per bid: a user turn adds it, another turn removes it."""
        at = F.lit(NOW).cast("timestamp") + span(hours=F.col("turn"))
        return self.raw("conversations").select(
            F.col("conv_id").alias("bid_id"), F.col("turn").alias("event_no"), (F.col("role") == "user").alias("added"), at.alias("at"), F.col("role").alias("entry")
        )

    @cached_property
    def analyses(self) -> DataFrame:
        k = F.col("o_orderkey")
        return self.raw("orders").filter(k % 4 != 0).select(
            k.alias("bid_id"), pick(["pronta", "processando", "erro", "nunca"], k % 4).alias("state"),
            F.concat(F.lit("resumo "), k.cast("string")).alias("summary"), F.concat(F.lit("f"), (k % 3).cast("string")).alias("fingerprint"), (k % 9 == 0).alias("final_format"),
        )

    @cached_property
    def sources(self) -> DataFrame:
        """Source texts of the analysis: the given documents, three to a bid."""
        return self.raw("documents").select("doc_id", F.floor(F.col("doc_id") / 3).alias("bid_id"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("source_id"), F.col("doc_id").alias("ord"), "text")

    @cached_property
    def answers(self) -> DataFrame:
        """Extracted answers: each quotes its document, some its middle, some two places with an ellipsis between, and cites that document or its neighbour."""
        k = F.col("doc_id")
        lines = F.split("text", "\n")
        two = F.concat_ws(" [...] ", F.element_at(lines, 1), F.element_at(lines, -1))
        middle = F.expr("substring(text, cast(length(text) div 2 as int) + 1, cast(20 + doc_id % 200 as int))")
        first = F.when(k % 6 == 5, two).when(k % 6 == 4, middle).otherwise(F.element_at(lines, 1))
        cited = F.array(F.concat(F.lit("doc-"), (k + k % 2).cast("string")), F.concat(F.lit("nada-"), k.cast("string")))
        return self.raw("documents").select(
            k.alias("answer_id"), F.floor((k + F.when(k % 4 == 3, 3).otherwise(0)) / 3).alias("bid_id"),
            F.when(k % 3 == 0, "prazos").when(k % 3 == 1, "requisitos").otherwise("habilitacao").alias("section"),
            F.when(k % 5 == 0, "Não se exige").when(k % 7 != 0, F.concat(F.lit("valor "), k.cast("string"))).alias("value"),
            F.when(k % 11 == 0, "O edital não menciona prazo").otherwise(first).alias("quote"), cited.alias("source_ids"),
        )


class Dealt(Tables):
    """The same tables, of which one is dealt over the tasks by ``by`` before anything is derived from it."""

    def __init__(self, spark: SparkSession, sf_dir: str, name: str, by: Column):
        super().__init__(spark, sf_dir)
        self._name, self._by = name, by

    def raw(self, name: str) -> DataFrame:
        return super().raw(name).repartition(self._by) if name == self._name else super().raw(name)
