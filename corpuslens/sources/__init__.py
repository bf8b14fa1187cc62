"""Readers, writers and data sources."""

from corpuslens.sources.files import append_new, read_json_lines, read_label_audit, read_xml_issues, write_json_lines, write_label_sheet

__all__ = ["append_new", "read_json_lines", "read_label_audit", "read_xml_issues", "write_json_lines", "write_label_sheet"]
