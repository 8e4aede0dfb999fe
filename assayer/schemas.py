"""Fixed schemas: the catalog table, the long column profile and stored documents."""

# One row per asset and run. Arrays are bounded by a table's own width or by an inline limit;
# the long frames (profiles, samples, edges) stay the complete record.
CATALOG = """
    table_id string, project_id string, dataset_id string, description string, table_type string,
    created timestamp, last_modified timestamp, last_accessed timestamp,
    row_count bigint, column_count bigint, size_bytes bigint,
    has_pii boolean, has_phi boolean, environment string,
    labels array<struct<key:string,value:string>>,
    schema array<struct<name:string,type:string,mode:string,description:string,sample_values:array<string>>>,
    analytical_insights array<string>,
    lineage array<struct<source:string,target:string>>,
    column_profiles array<struct<column_name:string,profile_type:string,min_value:string,max_value:string,
        avg_value:string,distinct_count:bigint,null_percentage:double>>,
    key_metrics array<struct<metric_name:string,metric_value:string>>,
    run_timestamp timestamp, insert_timestamp timestamp
"""

# One row per table and column; every measure is null where it does not apply.
PROFILE = """
    table_id string, column_name string, ordinal int, data_type string, profile_type string,
    total_rows bigint, null_count bigint, null_percentage double,
    distinct_count bigint, distinct_percentage double,
    min double, max double, avg double, stddev double, q1 double, median double, q3 double,
    min_length bigint, max_length bigint, avg_length double, min_value string, max_value string
"""

COLUMNS = """
    table_id string, column_name string, name string, ordinal int, depth int,
    data_type string, mode string, description string
"""

ASSETS = """
    project_id string, dataset_id string, table_id string, table_type string, path string, format string,
    description string, labels map<string,string>
"""

# A stored document; unknown fields of the structured part are dropped on read.
DOCUMENT = """
    id string,
    structData struct<project_id:string,dataset_id:string,table_id:string,data_source:string,asset_type:string,
        description:string,has_pii:boolean,has_phi:boolean,encryption_type:string,
        row_count:bigint,size_bytes:bigint,column_count:bigint,
        created_timestamp:string,last_modified_timestamp:string,last_accessed_timestamp:string,indexed_at:string,
        monthly_cost_usd:double,storage_cost_usd:double,query_cost_usd:double,
        owner_email:string,team:string,environment:string,cache_ttl:string,volatility:string,
        completeness_score:double,freshness_score:double,tags:array<string>>,
    content struct<mime_type:string,text:string>
"""
