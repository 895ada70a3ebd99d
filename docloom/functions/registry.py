"""The known parts of office packages, by format: what a coverage report holds a package's parts against."""

from __future__ import annotations

# Of each format the patterns of its parts in order, the content type of such a part (- where any will do) and
# the reader that takes it. Reports give them as they stand here.
_PARTS = """
word:
_rels/.rels application/vnd.openxmlformats-package.relationships+xml Relationships::parse
word/_rels/*.rels application/vnd.openxmlformats-package.relationships+xml Relationships::parse
docProps/core.xml application/vnd.openxmlformats-package.core-properties+xml parse_metadata(core)
docProps/app.xml application/vnd.openxmlformats-officedocument.extended-properties+xml parse_metadata(app)
docProps/custom.xml application/vnd.openxmlformats-officedocument.custom-properties+xml parse_custom_properties
customXml/*.xml application/xml parse_custom_xml_part
customXml/itemProps*.xml application/vnd.openxmlformats-officedocument.customXmlProperties+xml parse_custom_xml_part
_xmlsignatures/*.xml application/vnd.openxmlformats-package.digital-signature-xmlsignature+xml parse_shared_parts(signature)
_xmlsignatures/origin.sigs application/vnd.openxmlformats-package.digital-signature-origin parse_shared_parts(signature)
word/document.xml application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml DocxParser::parse_document
word/document.xml application/vnd.ms-word.document.macroEnabled.main+xml DocxParser::parse_document
word/glossary/document.xml application/vnd.openxmlformats-officedocument.wordprocessingml.document.glossary+xml DocxParser::parse_glossary_document
word/styles.xml application/vnd.openxmlformats-officedocument.wordprocessingml.styles+xml DocxParser::parse_styles
word/numbering.xml application/vnd.openxmlformats-officedocument.wordprocessingml.numbering+xml DocxParser::parse_numbering
word/comments.xml application/vnd.openxmlformats-officedocument.wordprocessingml.comments+xml DocxParser::parse_comments
word/commentsExtended.xml application/vnd.openxmlformats-officedocument.wordprocessingml.commentsExtended+xml DocxParser::parse_comments_extended
word/commentsIds.xml application/vnd.openxmlformats-officedocument.wordprocessingml.commentsIds+xml DocxParser::parse_comments_ids
word/footnotes.xml application/vnd.openxmlformats-officedocument.wordprocessingml.footnotes+xml DocxParser::parse_notes
word/endnotes.xml application/vnd.openxmlformats-officedocument.wordprocessingml.endnotes+xml DocxParser::parse_notes
word/header*.xml application/vnd.openxmlformats-officedocument.wordprocessingml.header+xml DocxParser::parse_header_footer
word/footer*.xml application/vnd.openxmlformats-officedocument.wordprocessingml.footer+xml DocxParser::parse_header_footer
word/settings.xml application/vnd.openxmlformats-officedocument.wordprocessingml.settings+xml DocxParser::parse_settings
word/webSettings.xml application/vnd.openxmlformats-officedocument.wordprocessingml.webSettings+xml DocxParser::parse_web_settings
word/fontTable.xml application/vnd.openxmlformats-officedocument.wordprocessingml.fontTable+xml DocxParser::parse_font_table
word/people.xml application/vnd.openxmlformats-officedocument.people+xml parse_people_part
word/theme/theme*.xml application/vnd.openxmlformats-officedocument.theme+xml parse_theme
word/drawings/*.xml application/vnd.openxmlformats-officedocument.drawing+xml parse_drawingml
word/charts/*.xml application/vnd.openxmlformats-officedocument.drawingml.chart+xml parse_chart_data
word/diagrams/data*.xml application/vnd.openxmlformats-officedocument.drawingml.diagramData+xml parse_smartart_data
word/diagrams/layout*.xml application/vnd.openxmlformats-officedocument.drawingml.diagramLayout+xml parse_smartart_layout
word/diagrams/colors*.xml application/vnd.openxmlformats-officedocument.drawingml.diagramColors+xml parse_smartart_colors
word/diagrams/quickStyle*.xml application/vnd.openxmlformats-officedocument.drawingml.diagramStyle+xml parse_smartart_style
word/media/* - parse_shared_parts(media)
word/embeddings/*.bin application/vnd.openxmlformats-officedocument.oleObject parse_shared_parts(ole)
word/vmlDrawing*.vml application/vnd.openxmlformats-officedocument.vmlDrawing parse_vml_drawing
word/comments*.xml.rels application/vnd.openxmlformats-package.relationships+xml Relationships::parse
word/footnotes.xml.rels application/vnd.openxmlformats-package.relationships+xml Relationships::parse
word/endnotes.xml.rels application/vnd.openxmlformats-package.relationships+xml Relationships::parse
word/vbaProject.bin application/vnd.ms-office.vbaProject scan_security_content(vba)
word/vbaData.xml application/vnd.ms-office.vbaData+xml scan_security_content(vba)
word/activeX/*.xml application/vnd.ms-office.activeX+xml scan_security_content(activex)
word/activeX/*.bin application/vnd.ms-office.activeX scan_security_content(activex)
word/webExtensions/webExtension*.xml application/vnd.ms-office.webextension+xml parse_web_extensions
word/webExtensions/taskpanes.xml application/vnd.ms-office.webextensiontaskpanes+xml parse_web_extension_taskpanes
spreadsheet:
_rels/.rels application/vnd.openxmlformats-package.relationships+xml Relationships::parse
xl/_rels/*.rels application/vnd.openxmlformats-package.relationships+xml Relationships::parse
docProps/core.xml application/vnd.openxmlformats-package.core-properties+xml parse_metadata(core)
docProps/app.xml application/vnd.openxmlformats-officedocument.extended-properties+xml parse_metadata(app)
docProps/custom.xml application/vnd.openxmlformats-officedocument.custom-properties+xml parse_custom_properties
customXml/*.xml application/xml parse_custom_xml_part
customXml/itemProps*.xml application/vnd.openxmlformats-officedocument.customXmlProperties+xml parse_custom_xml_part
_xmlsignatures/*.xml application/vnd.openxmlformats-package.digital-signature-xmlsignature+xml parse_shared_parts(signature)
_xmlsignatures/origin.sigs application/vnd.openxmlformats-package.digital-signature-origin parse_shared_parts(signature)
xl/workbook.xml application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml XlsxParser::parse_workbook
xl/workbook.xml application/vnd.ms-excel.sheet.macroEnabled.main+xml XlsxParser::parse_workbook
xl/workbook.bin application/vnd.ms-excel.sheet.binary.macroEnabled.main OoxmlParser::parse_xlsb
xl/worksheets/*.xml application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml XlsxParser::parse_worksheet
xl/chartsheets/*.xml application/vnd.openxmlformats-officedocument.spreadsheetml.chartsheet+xml XlsxParser::parse_chartsheet
xl/dialogsheets/*.xml application/vnd.openxmlformats-officedocument.spreadsheetml.dialogsheet+xml XlsxParser::parse_worksheet
xl/macrosheets/*.xml application/vnd.ms-excel.macrosheet+xml XlsxParser::parse_worksheet
xl/sharedStrings.xml application/vnd.openxmlformats-officedocument.spreadsheetml.sharedStrings+xml parse_shared_strings_table
xl/styles.xml application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml parse_styles
xl/calcChain.xml application/vnd.openxmlformats-officedocument.spreadsheetml.calcChain+xml parse_calc_chain
xl/comments*.xml application/vnd.openxmlformats-officedocument.spreadsheetml.comments+xml parse_sheet_comments
xl/threadedComments/*.xml application/vnd.openxmlformats-officedocument.spreadsheetml.threadedComments+xml parse_threaded_comments
xl/drawings/*.xml application/vnd.openxmlformats-officedocument.drawing+xml XlsxParser::parse_drawing
xl/charts/*.xml application/vnd.openxmlformats-officedocument.drawingml.chart+xml XlsxParser::parse_chart
xl/pivotTables/*.xml application/vnd.openxmlformats-officedocument.spreadsheetml.pivotTable+xml parse_pivot_table_definition
xl/pivotCache/pivotCacheDefinition*.xml application/vnd.openxmlformats-officedocument.spreadsheetml.pivotCacheDefinition+xml parse_pivot_cache
xl/pivotCache/pivotCacheRecords*.xml application/vnd.openxmlformats-officedocument.spreadsheetml.pivotCacheRecords+xml parse_pivot_cache_records
xl/tables/*.xml application/vnd.openxmlformats-officedocument.spreadsheetml.table+xml parse_table_definition
xl/queryTables/*.xml application/vnd.openxmlformats-officedocument.spreadsheetml.queryTable+xml parse_query_table
xl/connections.xml application/vnd.openxmlformats-officedocument.spreadsheetml.connections+xml parse_connections_part
xl/externalLinks/*.xml application/vnd.openxmlformats-officedocument.spreadsheetml.externalLink+xml parse_external_links
xl/metadata.xml application/vnd.openxmlformats-officedocument.spreadsheetml.sheetMetadata+xml parse_sheet_metadata
xl/embeddings/*.bin application/vnd.openxmlformats-officedocument.oleObject parse_shared_parts(ole)
xl/persons/person.xml application/vnd.openxmlformats-officedocument.spreadsheetml.person+xml parse_person_part
xl/slicers/*.xml application/vnd.ms-excel.slicer+xml parse_slicers
xl/timelines/*.xml application/vnd.ms-excel.timeline+xml parse_timelines
xl/activeX/*.xml application/vnd.ms-office.activeX+xml scan_security_content(activex)
xl/activeX/*.bin application/vnd.ms-office.activeX scan_security_content(activex)
xl/vbaProject.bin application/vnd.ms-office.vbaProject scan_security_content(vba)
presentation:
_rels/.rels application/vnd.openxmlformats-package.relationships+xml Relationships::parse
ppt/_rels/*.rels application/vnd.openxmlformats-package.relationships+xml Relationships::parse
docProps/core.xml application/vnd.openxmlformats-package.core-properties+xml parse_metadata(core)
docProps/app.xml application/vnd.openxmlformats-officedocument.extended-properties+xml parse_metadata(app)
docProps/custom.xml application/vnd.openxmlformats-officedocument.custom-properties+xml parse_custom_properties
customXml/*.xml application/xml parse_custom_xml_part
customXml/itemProps*.xml application/vnd.openxmlformats-officedocument.customXmlProperties+xml parse_custom_xml_part
_xmlsignatures/*.xml application/vnd.openxmlformats-package.digital-signature-xmlsignature+xml parse_shared_parts(signature)
_xmlsignatures/origin.sigs application/vnd.openxmlformats-package.digital-signature-origin parse_shared_parts(signature)
ppt/presentation.xml application/vnd.openxmlformats-officedocument.presentationml.presentation.main+xml PptxParser::parse_presentation
ppt/presentation.xml application/vnd.ms-powerpoint.presentation.macroEnabled.main+xml PptxParser::parse_presentation
ppt/presentation.xml application/vnd.openxmlformats-officedocument.presentationml.presentation.main+xml parse_presentation_info
ppt/slides/*.xml application/vnd.openxmlformats-officedocument.presentationml.slide+xml PptxParser::parse_slide
ppt/presProps.xml application/vnd.openxmlformats-officedocument.presentationml.presProps+xml parse_presentation_properties
ppt/viewProps.xml application/vnd.openxmlformats-officedocument.presentationml.viewProps+xml parse_view_properties
ppt/tableStyles.xml application/vnd.openxmlformats-officedocument.presentationml.tableStyles+xml parse_table_styles
ppt/slideMasters/*.xml application/vnd.openxmlformats-officedocument.presentationml.slideMaster+xml parse_slide_master
ppt/slideLayouts/*.xml application/vnd.openxmlformats-officedocument.presentationml.slideLayout+xml parse_slide_layout
ppt/notesMasters/*.xml application/vnd.openxmlformats-officedocument.presentationml.notesMaster+xml parse_notes_master
ppt/handoutMasters/*.xml application/vnd.openxmlformats-officedocument.presentationml.handoutMaster+xml parse_handout_master
ppt/notesSlides/*.xml application/vnd.openxmlformats-officedocument.presentationml.notesSlide+xml parse_notes_slide
ppt/diagrams/data*.xml application/vnd.openxmlformats-officedocument.drawingml.diagramData+xml parse_smartart_data
ppt/diagrams/layout*.xml application/vnd.openxmlformats-officedocument.drawingml.diagramLayout+xml parse_smartart_layout
ppt/diagrams/colors*.xml application/vnd.openxmlformats-officedocument.drawingml.diagramColors+xml parse_smartart_colors
ppt/diagrams/quickStyle*.xml application/vnd.openxmlformats-officedocument.drawingml.diagramStyle+xml parse_smartart_style
ppt/charts/*.xml application/vnd.openxmlformats-officedocument.drawingml.chart+xml parse_chart_data
ppt/media/* - parse_shared_parts(media)
ppt/embeddings/*.bin application/vnd.openxmlformats-officedocument.oleObject parse_shared_parts(ole)
ppt/commentAuthors.xml application/vnd.openxmlformats-officedocument.presentationml.commentAuthors+xml parse_comment_authors
ppt/comments/*.xml application/vnd.openxmlformats-officedocument.presentationml.comments+xml parse_comments
ppt/tags/*.xml application/vnd.openxmlformats-officedocument.presentationml.tags+xml parse_presentation_tags
ppt/people.xml application/vnd.openxmlformats-officedocument.people+xml parse_people_part
ppt/activeX/*.xml application/vnd.ms-office.activeX+xml scan_security_content(activex)
ppt/activeX/*.bin application/vnd.ms-office.activeX scan_security_content(activex)
ppt/vbaProject.bin application/vnd.ms-office.vbaProject scan_security_content(vba)
"""


def _rows() -> list[tuple[str, int, str, str | None, str]]:
    found, form = [], ""
    for line in _PARTS.split("\n"):
        if line.endswith(":"):
            form = line[:-1]
        elif line:
            pattern, kind, reader = line.split(" ")
            found.append((form, len(found), pattern, None if kind == "-" else kind, reader))
    return found


#: (format, ord, pattern, expected, parser), a row for each pattern.
ROWS = _rows()
SCHEMA = "format string, spec int, pattern string, expected string, parser string"
