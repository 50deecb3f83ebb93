"""docsync: keep a searchable document table in step with a changing collection of files and pages."""
