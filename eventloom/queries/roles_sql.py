"""The same roles as SQL common table expressions for the comparison engine."""

from __future__ import annotations

import re

_ROLES = {
    # ---------------------------------------------------------------- stream domain
    "ev": """
        SELECT user_id AS person_id, event_id, 'measurement' AS domain,
               CASE event_type WHEN 'view' THEN 1 WHEN 'signup' THEN 2 WHEN 'purchase' THEN 3 WHEN 'error' THEN 4 WHEN 'click' THEN 5 END AS concept_id,
               CAST(ts AS DATE) AS event_date, value,
               CASE WHEN k % 10 = 0 THEN NULL WHEN k % 3 = 0 THEN 902 ELSE 901 END AS value_concept_id,
               CASE WHEN k % 20 = 0 THEN 'Not detected' WHEN k % 10 = 0 THEN 'Detected' END AS value_text,
               CASE WHEN k % 2 = 0 THEN CAST(50.0 AS DOUBLE) END AS range_high,
               event_type || ':' || k AS source_text,
               CASE WHEN k % 7 = 0 THEN NULL ELSE k % 3 END AS source_concept_id, k
        FROM (SELECT *, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) AS k FROM events)""",
    "s_index": "SELECT person_id, min(event_date) AS index_date FROM ev WHERE concept_id = 2 GROUP BY 1",
    "s_cohort": """
        SELECT i.person_id, i.index_date, o.first_outcome_date,
               CASE WHEN o.first_outcome_date - i.index_date >= 5 THEN 1 ELSE 0 END AS label,
               i.index_date AS acute_start, i.index_date + 10 AS acute_end
        FROM s_index i LEFT JOIN (SELECT person_id, min(event_date) AS first_outcome_date FROM ev WHERE concept_id = 4 AND value > 80 GROUP BY 1) o USING (person_id)""",
    "s_win": """
        SELECT person_id, index_date, 'w' || a || '_' || b AS win, a AS w_start, b AS w_end, index_date + a AS ws, index_date + b AS we
        FROM s_cohort CROSS JOIN (VALUES (0,5),(0,10),(0,15),(5,10),(10,20)) w(a, b)""",
    "s_evw": """
        SELECT e.*, w.win, w.index_date, w.ws, w.we, e.event_date - w.index_date AS day, e.event_date - w.ws AS day_in
        FROM ev e JOIN s_win w ON e.person_id = w.person_id AND e.event_date BETWEEN w.ws AND w.we""",
    # ---------------------------------------------------------------- order domain
    "visits": """
        SELECT o_custkey AS person_id, o_orderkey AS event_id, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS concept_id,
               CAST(o_orderdate AS DATE) AS event_date,
               CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) + CAST(o_orderkey % 12 AS INTEGER) END AS end_date,
               o_orderkey % 10 AS provider_id, c_nationkey AS site_id
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "lines": """
        SELECT l.*, o_custkey AS person_id, l_orderkey * 8 + l_linenumber AS event_id, CAST(l_shipdate AS DATE) AS event_date
        FROM lineitem l JOIN orders ON l_orderkey = o_orderkey""",
    "conditions": """
        SELECT person_id, event_id, event_date, l_suppkey + 5000000 AS concept_id, l_linestatus || ':' || l_suppkey AS source_text
        FROM lines WHERE l_returnflag = 'R'""",
    "procedures": """
        SELECT person_id, event_id, event_date, l_partkey AS concept_id, l_linestatus || ':' || l_linenumber AS source_text
        FROM lines WHERE l_returnflag = 'A'""",
    "observations": """
        SELECT person_id, event_id, event_date, l_partkey AS concept_id, l_linestatus || ':' || l_linenumber AS source_text,
               CASE WHEN l_quantity > 10 THEN l_quantity END AS value
        FROM lines WHERE l_returnflag = 'N'""",
    "drugs": """
        SELECT person_id, event_id, event_date, l_partkey AS concept_id, p_name AS source_text
        FROM lines JOIN part ON l_partkey = p_partkey""",
    "part_types": "SELECT p_type, 2000000 + row_number() OVER (ORDER BY p_type) AS type_id FROM (SELECT DISTINCT p_type FROM part)",
    "concept": """
        SELECT DISTINCT p_partkey AS concept_id, p_name AS concept_name, p_brand AS concept_code, 'PART' AS vocabulary_id, 'Drug' AS domain_id, 'Item' AS concept_class_id FROM part
        UNION ALL SELECT DISTINCT 1000000 + CAST(substr(p_brand, 7) AS BIGINT), p_brand, p_brand, 'PART', 'Drug', 'Ingredient' FROM part
        UNION ALL SELECT type_id, p_type, p_type, 'PART', 'Drug', 'Class' FROM part_types
        UNION ALL SELECT s_suppkey + 5000000, s_name, s_name, 'SUPP', 'Condition', 'Item' FROM supplier
        UNION ALL SELECT n_nationkey + 3000000, n_name, n_name, 'SUPP', 'Condition', 'Class' FROM nation
        UNION ALL SELECT r_regionkey + 4000000, r_name, r_name, 'SUPP', 'Condition', 'Class' FROM region""",
    "closure": """
        SELECT concept_id AS anc, concept_id AS des FROM concept
        UNION ALL SELECT 1000000 + CAST(substr(p_brand, 7) AS BIGINT), p_partkey FROM part
        UNION ALL SELECT type_id, p_partkey FROM part JOIN part_types USING (p_type)
        UNION ALL SELECT s_nationkey + 3000000, s_suppkey + 5000000 FROM supplier
        UNION ALL SELECT n_regionkey + 4000000, s_suppkey + 5000000 FROM supplier JOIN nation ON s_nationkey = n_nationkey
        UNION ALL SELECT n_regionkey + 4000000, n_nationkey + 3000000 FROM nation""",
    "person": """
        SELECT c_custkey AS person_id, DATE '1940-01-01' + CAST(c_custkey * 37 % 20000 AS INTEGER) AS birth_date,
               CASE c_custkey % 3 WHEN 0 THEN 8507 WHEN 1 THEN 8532 ELSE 0 END AS gender_concept_id,
               3000000 + c_nationkey AS race_concept_id, 4000000 + c_custkey % 5 AS ethnicity_concept_id
        FROM customer""",
    "extent": """
        SELECT o_custkey AS person_id, min(CAST(o_orderdate AS DATE)) AS obs_start, max(CAST(o_orderdate AS DATE)) AS obs_end
        FROM orders GROUP BY 1""",
    "deaths": "SELECT person_id, obs_end + 30 AS death_date FROM extent JOIN customer ON person_id = c_custkey WHERE c_acctbal < 0",
    "plans": """
        SELECT person_id, c_mktsegment AS payer, obs_start AS plan_start, CASE WHEN person_id % 2 = 0 THEN NULL ELSE obs_end END AS plan_end
        FROM extent JOIN customer ON person_id = c_custkey""",
    "providers": "SELECT s_suppkey AS provider_id, s_nationkey + 3000000 AS specialty_concept_id, s_name AS specialty_source_value FROM supplier",
    "ontology_raw": """
        SELECT p_partkey AS concept_id,
               'HP_' || lpad(CAST(p_partkey % 40 AS VARCHAR), 7, '0') AS t0, 'HP_' || lpad(CAST((p_partkey + 7) % 40 AS VARCHAR), 7, '0') AS t1,
               p_name AS l0, p_type AS l1,
               CASE WHEN p_size > 10 THEN 'Manual One-to-One Concept' ELSE 'Unmapped' END AS mapping_category
        FROM part""",
    "ontology": """
        SELECT concept_id, 'HP:' || substr(t0, 4) AS term_id, l0 AS term_label, mapping_category FROM ontology_raw WHERE mapping_category <> 'Unmapped'
        UNION ALL SELECT concept_id, 'HP:' || substr(t1, 4), l1, mapping_category FROM ontology_raw WHERE mapping_category <> 'Unmapped'""",
    "outcome": "SELECT o_custkey AS person_id, min(CAST(o_orderdate AS DATE)) AS first_outcome_date FROM orders WHERE o_orderstatus = 'P' GROUP BY 1",
    "idx": "SELECT person_id, min(event_date) AS index_date FROM visits WHERE concept_id = 1 GROUP BY 1",
    "labelled": """
        SELECT person_id, index_date, first_outcome_date, CASE WHEN first_outcome_date - index_date >= 90 THEN 1 ELSE 0 END AS label
        FROM idx LEFT JOIN outcome USING (person_id)""",
    "setting": """
        SELECT l.*, d.discharge_date, CASE WHEN d.discharge_date IS NOT NULL THEN 1 ELSE 0 END AS is_inpatient
        FROM labelled l LEFT JOIN (
            SELECT i.person_id, max(coalesce(v.end_date, v.event_date)) AS discharge_date
            FROM idx i JOIN visits v ON v.person_id = i.person_id AND v.concept_id IN (2, 3)
             AND v.event_date <= i.index_date + 16 AND coalesce(v.end_date, v.event_date) >= i.index_date - 1
            GROUP BY 1) d USING (person_id)""",
    "acute": """
        SELECT *, index_date AS acute_start,
               CASE WHEN is_inpatient = 1 THEN greatest(index_date + 21, discharge_date) ELSE index_date + 21 END AS acute_end
        FROM setting""",
    "cutoff": """
        SELECT max(obs_end) AS data_cutoff FROM extent
        WHERE obs_end - DATE '1970-01-01' <= (SELECT quantile_cont(obs_end - DATE '1970-01-01', 0.999) FROM extent)""",
    "followed": """
        SELECT *, CASE WHEN insufficient_followup = 1 THEN 'censored' WHEN label = 1 THEN 'positive' ELSE 'confirmed_negative' END AS eligibility_status
        FROM (
            SELECT *, CASE WHEN label = 0 AND followup_days < 90 THEN 1 ELSE 0 END AS insufficient_followup
            FROM (
                SELECT a.*, d.death_date, x.obs_end,
                       CASE WHEN d.death_date IS NULL THEN 'alive'
                            WHEN label = 1 AND d.death_date >= first_outcome_date THEN 'd_post_outcome_true_positive'
                            WHEN d.death_date <= index_date THEN 'a_pre_index_ineligible'
                            WHEN d.death_date <= acute_end THEN 'b_in_acute_window' ELSE 'post_acute_death' END AS death_bucket,
                       least(x.obs_end, d.death_date, (SELECT data_cutoff FROM cutoff)) AS last_obs_date,
                       least(x.obs_end, d.death_date, (SELECT data_cutoff FROM cutoff)) - index_date AS followup_days
                FROM acute a LEFT JOIN deaths d USING (person_id) LEFT JOIN extent x USING (person_id)
                WHERE d.death_date IS NULL OR d.death_date > greatest(a.index_date, a.acute_end)))""",
    "cohort": """
        SELECT f.*, CAST(floor((f.index_date - p.birth_date) / 365.25) AS BIGINT) AS age_at_index, p.gender_concept_id
        FROM followed f LEFT JOIN person p USING (person_id)""",
    "o_win": """
        SELECT person_id, index_date, 'w' || a || '_' || b AS win, a AS w_start, b AS w_end, index_date + a AS ws, index_date + b AS we
        FROM cohort CROSS JOIN (VALUES (0,21),(0,30),(0,60),(0,90),(30,60),(60,90)) w(a, b)""",
    # ---------------------------------------------------------------- evaluation domain
    "results": """
        SELECT event_type AS config, 'w' || (k % 6) AS feature_window, user_id % 100 AS iteration,
               avg(value) / 499 AS auroc, max(value) / 997 AS auprc, 42 + (user_id % 100) * 1000 AS seed
        FROM (SELECT *, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) AS k FROM events) GROUP BY 1, 2, 3, 6""",
    "predictions": """
        SELECT l_orderkey * 8 + l_linenumber AS row_id, l_linenumber AS seed, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y_true,
               (l_extendedprice % 1000 + 1) / 1002 AS p_raw FROM lineitem""",
}


def _needed(sql: str, found: set[str]) -> None:
    for name, body in _ROLES.items():
        if name not in found and re.search(rf"\b{name}\b", sql):
            found.add(name)
            _needed(body, found)


def with_roles(sql: str) -> str:
    """Prefix the roles that a statement uses."""
    found: set[str] = set()
    _needed(sql, found)
    ctes = [f"{name} AS ({body})" for name, body in _ROLES.items() if name in found]
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {', '.join([*ctes, body[5:]])}" if ctes else body
    return f"WITH {', '.join(ctes)} {body}" if ctes else body
