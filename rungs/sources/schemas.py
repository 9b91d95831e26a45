"""Schemas of the payloads and of the tables made from them; nothing is inferred."""

from __future__ import annotations

LADDER = "season_id BIGINT, bracket STRING, region STRING, fetched_at TIMESTAMP, offset BIGINT, entries ARRAY<STRUCT<character: STRUCT<id: BIGINT, name: STRING, realm: STRUCT<slug: STRING>>, faction: STRUCT<type: STRING>, rank: INT, rating: INT, season_match_statistics: STRUCT<won: INT, lost: INT>>>"

EQUIPMENT = (
    "character_id BIGINT, spec_id INT, equipped_items ARRAY<STRUCT<item: STRUCT<id: BIGINT>, slot: STRUCT<type: STRING>, level: STRUCT<value: INT>, name: STRING, inventory_type: STRUCT<type: STRING>, "
    "item_class: STRUCT<name: STRING>, item_subclass: STRUCT<name: STRING>, media: STRUCT<id: BIGINT>, quality: STRUCT<type: STRING>, context: STRING, bonus_list: ARRAY<INT>, "
    "enchantments: ARRAY<STRUCT<display_string: STRING, enchantment_id: BIGINT, enchantment_slot: STRUCT<type: STRING>, source_item: STRUCT<id: BIGINT>>>, "
    "sockets: ARRAY<STRUCT<socket_type: STRUCT<type: STRING>, item: STRUCT<id: BIGINT, name: STRING>, display_string: STRING>>, spells: ARRAY<STRUCT<spell: STRUCT<id: BIGINT>>>, "
    "modified_crafting_stat: ARRAY<STRUCT<type: STRING>>, stats: ARRAY<STRUCT<type: STRUCT<type: STRING>, value: INT, is_negated: BOOLEAN>>, "
    "set: STRUCT<item_set: STRUCT<id: BIGINT, name: STRING>, items: ARRAY<STRUCT<is_equipped: BOOLEAN>>, effects: ARRAY<STRUCT<required_count: INT, is_active: BOOLEAN>>>>>"
)

_PICK = "ARRAY<STRUCT<rank: INT, default_points: INT, tooltip: STRUCT<talent: STRUCT<id: BIGINT, name: STRING>>>>"
SPECIALIZATIONS = (
    "character_id BIGINT, active_specialization STRUCT<id: BIGINT, name: STRING>, active_hero_talent_tree STRUCT<id: BIGINT, name: STRING>, specializations ARRAY<STRUCT<specialization: STRUCT<id: BIGINT, name: STRING>, "
    f"loadouts: ARRAY<STRUCT<is_active: BOOLEAN, talent_loadout_code: STRING, selected_class_talents: {_PICK}, selected_spec_talents: {_PICK}, selected_hero_talents: {_PICK}, "
    "selected_class_talent_tree: STRUCT<name: STRING>, selected_hero_talent_tree: STRUCT<id: BIGINT, name: STRING>>>, "
    "pvp_talent_slots: ARRAY<STRUCT<selected: STRUCT<talent: STRUCT<id: BIGINT, name: STRING>, spell_tooltip: STRUCT<spell: STRUCT<id: BIGINT>>>>>>>"
)

_TIP = "STRUCT<talent: STRUCT<id: BIGINT, name: STRING>, spell_tooltip: STRUCT<spell: STRUCT<id: BIGINT>>>"
#: locked_by has numbers or objects in it: it lands as text, element by element.
_NODES = f"ARRAY<STRUCT<id: BIGINT, display_row: INT, display_col: INT, locked_by: ARRAY<STRING>, ranks: ARRAY<STRUCT<tooltip: {_TIP}, choice_of_tooltips: ARRAY<{_TIP}>>>>>"
TREES = f"spec_id INT, class_talent_nodes {_NODES}, spec_talent_nodes {_NODES}, hero_talent_trees ARRAY<STRUCT<id: BIGINT, name: STRING, hero_talent_nodes: {_NODES}, nodes: {_NODES}>>"

SEASON = "season_id BIGINT, season_name STRING, season_start_timestamp BIGINT, season_end_timestamp BIGINT"
MEDIA = "id BIGINT, assets ARRAY<STRUCT<key: STRING, value: STRING>>"
PROFILE = "id BIGINT, name STRING, realm STRUCT<slug: STRING>, race STRUCT<id: INT, name: STRING>, character_class STRUCT<id: INT, name: STRING>, faction STRUCT<type: STRING>"
METRICS = "job_id BIGINT, job_class STRING, at TIMESTAMP, duration DOUBLE, success BOOLEAN, error_class STRING"
