"""Schemas and domains of the ledger."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)
INCOME, EXPENSE, TAX, TRANSFER = "Receita", "Despesa", "Imposto", "Transferência Interna"
TYPES = (INCOME, EXPENSE, TAX, TRANSFER)
NEEDED, DOUBTFUL, SURPLUS = "Obrigatório", "Questionável", "Supérfluo"
CLASSES = (NEEDED, DOUBTFUL, SURPLUS)

LEDGER = T.StructType(
    [
        T.StructField("identificador", T.LongType()),
        T.StructField("data", T.DateType()),
        T.StructField("mes_ref", T.StringType()),
        T.StructField("valor", MONEY),
        T.StructField("tipo", T.StringType()),
        T.StructField("classificacao", T.StringType()),
        T.StructField("quem", T.StringType()),
        T.StructField("banco_origem", T.StringType()),
        T.StructField("local", T.StringType()),
        T.StructField("categoria", T.StringType()),
    ]
)
