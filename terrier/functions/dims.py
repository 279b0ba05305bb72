"""Constant dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Operation codes of register HB.
OPERATION_CODES = {
    "DA": "Em", "DB": "Eb", "PT": "Hb", "PP": "Ed", "RF": "Ca", "RC": "En", "EJ": "Ej", "CU": "Bb", "EL": "Ga", "SC": "Ei", "PI": "Hb", "PF": "Ed",
    "LO": "Ia", "IM": "Fa", "CO": "Fa", "DP": "Em", "DADA": "Em", "DL": "Em", "lM": "Fa", "Dl": "Em", "Pl": "Hb", "co": "Fa", "cu": "Bb", "pp": "Ed",
}
#: Statuses of the review and of the publication service.
STATUS_CODES = {"Achevé": "achevé", "Indéterminé": "indéterminé", "En cours": "en production", "Annulé": "annulé", "Archivé": "achevé"}
#: The register of each surveyor.
REGISTERS = {"HARROIS": "HB", "BARRIAL": "HB", "RACAT": "RC", "CEYTE": "RC", "DUPUY": "D", "SERRET": "S"}
#: Known surveyors, in this order.
SURVEYORS = ("DUPUY Roger", "HARROIS Gervais", "RACAT", "SERRET Fernand", "CEYTE", "BARRIAL", "ROBERT Lionnel", "LACOUR Jacques")


def two_columns(spark: SparkSession, table: dict[str, str], key: str = "code", value: str = "label") -> DataFrame:
    return spark.createDataFrame(sorted(table.items()), f"{key} string, {value} string")
