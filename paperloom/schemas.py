"""Row types of the document operators, declared once."""

from __future__ import annotations

RUN = "struct<id:string,text:string,bold:boolean,italic:boolean,underline:boolean,font_name:string,font_size:double,font_color:string,highlight_color:string>"
PARAGRAPH_FORMAT = "struct<left_indent:double,right_indent:double,first_line_indent:double,space_before:double,space_after:double,line_spacing:double>"
PARAGRAPH = f"doc_id string, ord int, para_id string, text string, alignment string, style_name string, runs array<{RUN}>, paragraph_format {PARAGRAPH_FORMAT}, fallback boolean"
SPAN = "doc_id bigint, page_num int, block_no int, block_type int, line_no int, span_no int, text string, font string, size double, x0 double, y0 double, x1 double, y1 double"
MEDIA = "doc_id string, entry string, name string, content binary"
EPUB_PART = "doc_id string, pos int, entry string, html string"
