"""Surfaces with the node that they mean, and how a threshold for links by similarity is chosen from them.

Only surfaces that aliases and the surface index leave open are judged, as only those reach the vectors. A wrong link
spoils every later score unseen, while a missed one is listed as unresolved; so of the thresholds without a wrong link
the lowest is chosen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import linking

# Ways in which skills of the graph are written, with their node; skills and notions that aren't in the
# graph, so that any link is wrong; and the thresholds that are compared.
KNOWN = {
    "kubernities": "Kubernetes", "kubernetes cluster": "Kubernetes", "Postgres SQL": "PostgreSQL",
    "PostgreSQL 15": "PostgreSQL", "ReactJS": "React", "React.js": "React", "VueJS": "Vue.js", "Node JS": "Node.js",
    "Scikit learn": "Scikit-learn", "sklearn": "Scikit-learn", "Tensor Flow": "TensorFlow",
    "TensorFlow 2": "TensorFlow", "Py Torch": "PyTorch", "Pandas library": "pandas", "numpy arrays": "NumPy",
    "Spring boot microservices": "Spring Boot", "MS Excel": "Microsoft Excel", "Excel spreadsheets": "Microsoft Excel",
    "Power BI dashboards": "Microsoft Power BI", "Azure": "Microsoft Azure software",
    "AWS EC2": "Amazon Elastic Compute Cloud EC2", "Amazon SageMaker": "Amazon Web Services AWS SageMaker",
    "Golang": "Go", "Rust": "Rust programming language", "Java 8": "Oracle Java", "Jenkins pipelines": "Jenkins CI",
    "Hugging Face Transformers": "Hugging Face", "Kafka Streams": "Apache Kafka", "Airflow DAGs": "Apache Airflow",
    "Shell scripting": "Shell script", "bash scripting": "Bash", "Linux administration": "Linux",
    "MongoDB Atlas": "MongoDB", "Redis cache": "Redis", "REST APIs": "RESTful API", "Selenium WebDriver": "Selenium",
    "Tableau dashboards": "Tableau", "XGBoost classifier": "XGBoost", "LightGBM model": "LightGBM", "Llama 2": "Llama",
    "LangChain agents": "LangChain", "MS SQL Server": "Microsoft SQL Server", "T-SQL": "Transact-SQL",
    "PL SQL": "Oracle PL/SQL", "TypeScript 5": "TypeScript", "AngularJS": "Google Angular", "Docker Compose": "Docker",
    "dockerized services": "Docker", "Prometheus monitoring": "Prometheus", "Git version control": "Git",
    "GitLab CI": "GitLab", "Unity 3D": "Unity Technologies Unity", "Unreal Engine 5": "Unreal Technology Unreal Engine",
    "Elastic search": "Elasticsearch", "Snowflake data warehouse": "Snowflake", "C sharp": "C#", "CPP": "C++",
    "FastAPI backend": "FastAPI", "Django REST framework": "Django", "GraphQL APIs": "GraphQL",
    "PySpark jobs": "PySpark", "Apache Spark Streaming": "Apache Spark",
}
FOREIGN = (
    "Object Oriented Programming", "Feature Engineering", "CNNs", "RNNs", "LSTMs", "neo4j", "graph database", "RAG",
    "SHAP", "Machine Learning", "Deep Learning", "Data Structures", "Algorithms", "Computer Vision",
    "Natural Language Processing", "Statistics", "Linear Regression", "Model Evaluation", "Microservices",
    "System Design", "Agile", "Scrum", "Communication", "Leadership", "Problem Solving", "WebSockets", "Pydantic",
    "Flask", "Next.js", "OpenCV", "Streamlit", "SpeechBrain", "PCGrad", "GANs", "Reinforcement Learning", "Firebase",
    "Supabase", "Heroku", "Nginx", "RabbitMQ", "Celery", "gRPC", "OAuth", "JWT", "CI/CD", "Unit testing",
    "Data Visualization", "Matplotlib", "Seaborn", "Plotly", "SciPy", "NLTK", "spaCy", "OpenAI API",
    "Prompt Engineering", "Vector databases", "Pinecone", "FAISS", "ChromaDB", "Cypher", "Redux", "Express.js", "Jest",
    "Cypress", "Operating Systems", "Computer Networks", "DBMS", "Cloud Computing", "Kotlin", "Dart", "Flutter",
    "Haskell", "Julia", "Verilog", "Arduino", "Blockchain", "Web3", "LLMs", "Transformer models", "Fine-tuning",
    "MLOps", "ETL pipelines", "A/B testing",
)
THRESHOLDS = (0.60, 0.65, 0.70, 0.72, 0.74, 0.75, 0.76, 0.78, 0.80, 0.82, 0.84, 0.85, 0.86, 0.88, 0.90)


def cases(spark: SparkSession) -> DataFrame:
    """surface, expected: the node, or null for a surface that must stay unresolved."""
    return spark.createDataFrame([*KNOWN.items(), *((s, None) for s in FOREIGN)], "surface string, expected string")


def absent(cases: DataFrame, nodes: DataFrame) -> DataFrame:
    """Expected nodes that the graph doesn't have; with any of them a calibration says nothing."""
    want = cases.where("expected IS NOT NULL").select(F.col("expected").alias("name")).distinct()
    return want.join(nodes.select("name"), "name", "left_anti").orderBy("name")


def open_cases(cases: DataFrame, nodes: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """The cases that neither an alias nor the surface index resolves."""
    asked = cases.select("surface").distinct().withColumn("weight", F.lit(1.0))
    left = linking.link(asked, nodes, aliases, use_embedding=False).where("node IS NULL")
    return cases.join(left.select("surface"), "surface", "left_semi")


def judged(cases: DataFrame, linker: linking.Linker) -> DataFrame:
    """surface, expected, found, score of the open cases, each with its most similar node, whatever the similarity."""
    rest = open_cases(cases, linker.nodes)
    near = linking.nearest_node(rest, linker.nodes, linker.embedder)
    return rest.join(near, "surface", "left").select("surface", "expected", F.col("node").alias("found"), F.coalesce("sim", F.lit(0.0)).alias("score"))


def table(judged: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """threshold, correct, missed, wrong_known (another node than the case's), wrong_foreign."""
    t = judged.sparkSession.createDataFrame([(float(x),) for x in thresholds], "threshold double")
    hit, known = F.col("score") >= F.col("threshold"), F.col("expected").isNotNull()
    right = F.coalesce(F.col("found") == F.col("expected"), F.lit(False))
    # a row for each case and threshold, both short lists
    return judged.crossJoin(F.broadcast(t)).groupBy("threshold").agg(
        F.count_if(known & hit & right).alias("correct"), F.count_if(known & ~hit).alias("missed"),
        F.count_if(known & hit & ~right).alias("wrong_known"), F.count_if(~known & hit).alias("wrong_foreign"),
    ).orderBy("threshold")


def chosen(table: DataFrame) -> float | None:
    """The lowest threshold without a wrong link; None if each has one."""
    return table.where("wrong_known = 0 AND wrong_foreign = 0").agg(F.min("threshold")).first()[0]
