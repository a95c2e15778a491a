"""Schemas of the tables that the lineage operators exchange."""

from __future__ import annotations

COMMENT = "filename string, job_code string, last_modif_date string, comment_id int, comment string"
STATEMENT = (
    "filename_path string, filename string, statement_id int, statement_type string, statement string, variable_list string, start_line int, end_line int, "
    "raw_statement_type string, raw_statement string, parent_statement_type string, parent_statement string, parent_start_line int, parent_end_line int, parent_statement_id int"
)
MAPPING_ITEM = (
    "struct<input_object_type:string,input_schema_path:string,input_table_name:string,input_subquery_sql:string,input_table_alias:string,input_field:string,"
    "output_object_type:string,output_schema_path:string,output_table:string,output_subquery_sql:string,output_field_alias:string,expression_sql:string,clause:string,filter_expression_sql:string>"
)
FIELD_COLUMNS = (
    "filename job_code last_modif_date statement_type input_object_type input_schema_path input_table_name input_subquery_sql input_table_alias input_field "
    "output_object_type output_schema_path output_table output_subquery_sql output_field_alias expression_sql clause statement filter_expression_sql statement_id"
).split()
# The impact report's columns; those that no operator fills are null.
IMPACT_COLUMNS = (
    "process_type job_code level sub_level filename file_path last_modif_date source_object_name field_name input_object_type input_schema_path input_table_name "
    "input_field input_subquery_sql output_object_type output_schema_path output_table output_field_alias output_subquery_sql expression_sql functional_definition "
    "flg_has_impact filter_expression_sql statement cross surrogate statement_id statement_type clause"
).split()
# The three heads of that report, section by section.
IMPACT_BANDS = (("PROCESO IMPACTADO", 7), ("OBJETO FUENTE", 2), ("ORIGEN DE IMPACTO", 5), ("DESTINO DEL IMPACTO", 5), ("DETALLE DEL IMPACTO", 7), ("DATOS TECNICOS", 3))
_MUST, _OWN = "Campo Obligatorio", "Campo de la herramienta"
IMPACT_KINDS = (
    _MUST, _MUST, _MUST, "", _MUST, _MUST, "", "OBJETO FUENTE", "CAMPO FUENTE", _MUST, _MUST, _MUST, _MUST, _OWN, _MUST, _MUST, _MUST, _MUST, _OWN,
    _MUST, _MUST, _MUST, _MUST, "", "", "", _OWN, _OWN, _OWN,
)
IMPACT_LABELS = (
    "TIPO PROCESO", "JOB", "NIVEL", "SUBNIVEL", "NOMBRE", "RUTA DEL PROCESO", "FECHA ULTIMA MODIFICACIÓN", "NOMBRE DEL OBJETO FUENTE (ANÁLISIS DE IMPACTO)", "NOMBRE DEL CAMPO",
    "TIPO OBJETO", "ESQUEMA/RUTA", "NOMBRE", "CAMPO", "DETALLE SUBCONSULTA", "TIPO OBJETO", "ESQUEMA/RUTA", "NOMBRE", "CAMPO", "DETALLE SUBCONSULTA",
    "CÁLCULOS O TRANSFORMACIONES", "DEFINICIÓN FUNCIONAL DEL CÁLCULO O TRANSFORMACIONES", "¿HAY IMPACTO?", "DESCRIPCIÓN FILTRO TABLA", "SCRIPT", "CROSS", "SUBROGADA",
    "ID STATEMENT", "TIPO STATEMENT", "CLAUSE",
)
