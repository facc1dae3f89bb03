"""Queries over the driver's tables and the SQL that must give the same rows."""

from bidloom.plans import cells, commercial, decided, documents, exports, fields, files, lifecycle, procurement, requirements, reviews, rules, sheets, text

QUERIES = commercial.QUERIES | text.QUERIES | procurement.QUERIES | documents.QUERIES | requirements.QUERIES | reviews.QUERIES | sheets.QUERIES | fields.QUERIES | files.QUERIES | lifecycle.QUERIES | decided.QUERIES | rules.QUERIES | cells.QUERIES | exports.QUERIES
ORACLE = commercial.ORACLE | text.ORACLE | procurement.ORACLE | documents.ORACLE | requirements.ORACLE | reviews.ORACLE | sheets.ORACLE | fields.ORACLE | files.ORACLE | lifecycle.ORACLE | decided.ORACLE | rules.ORACLE | cells.ORACLE | exports.ORACLE
