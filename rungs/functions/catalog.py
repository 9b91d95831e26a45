"""Specialisations of the game: id, class and role."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Spec id, spec slug, class id, class slug, role.
SPECS = [
    (62, "arcane", 8, "mage", "dps"),
    (63, "fire", 8, "mage", "dps"),
    (64, "frost", 8, "mage", "dps"),
    (65, "holy", 2, "paladin", "healer"),
    (66, "protection", 2, "paladin", "tank"),
    (70, "retribution", 2, "paladin", "dps"),
    (71, "arms", 1, "warrior", "dps"),
    (72, "fury", 1, "warrior", "dps"),
    (73, "protection", 1, "warrior", "tank"),
    (102, "balance", 11, "druid", "dps"),
    (103, "feral", 11, "druid", "dps"),
    (104, "guardian", 11, "druid", "tank"),
    (105, "restoration", 11, "druid", "healer"),
    (250, "blood", 6, "death_knight", "tank"),
    (251, "frost", 6, "death_knight", "dps"),
    (252, "unholy", 6, "death_knight", "dps"),
    (253, "beast-mastery", 3, "hunter", "dps"),
    (254, "marksmanship", 3, "hunter", "dps"),
    (255, "survival", 3, "hunter", "dps"),
    (256, "discipline", 5, "priest", "healer"),
    (257, "holy", 5, "priest", "healer"),
    (258, "shadow", 5, "priest", "dps"),
    (259, "assassination", 4, "rogue", "dps"),
    (260, "outlaw", 4, "rogue", "dps"),
    (261, "subtlety", 4, "rogue", "dps"),
    (262, "elemental", 7, "shaman", "dps"),
    (263, "enhancement", 7, "shaman", "dps"),
    (264, "restoration", 7, "shaman", "healer"),
    (265, "affliction", 9, "warlock", "dps"),
    (266, "demonology", 9, "warlock", "dps"),
    (267, "destruction", 9, "warlock", "dps"),
    (268, "brewmaster", 10, "monk", "tank"),
    (269, "windwalker", 10, "monk", "dps"),
    (270, "mistweaver", 10, "monk", "healer"),
    (577, "havoc", 12, "demon_hunter", "dps"),
    (581, "vengeance", 12, "demon_hunter", "tank"),
    (1467, "devastation", 13, "evoker", "dps"),
    (1468, "preservation", 13, "evoker", "healer"),
    (1473, "augmentation", 13, "evoker", "dps"),
    (1480, "devourer", 12, "demon_hunter", "dps"),
]

#: Brackets that discovery passes over.
SKIPPED_BRACKETS = ("shuffle-overall", "blitz-overall", "rbg")


def catalog(spark: SparkSession) -> DataFrame:
    """spec_id, spec_slug, class_id, class_slug, role: forty rows."""
    return spark.createDataFrame(SPECS, "spec_id int, spec_slug string, class_id int, class_slug string, role string")
