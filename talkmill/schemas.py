"""Table schemas (Spark DDL). Times inside a video are seconds as DOUBLE."""

VIDEO_REQUESTS = (
    "video_url string, company_name string, bucket_name string, source string, "
    "meeting_link string, request_ts timestamp"
)
SEGMENTS = "array<struct<text:string,start:double,end:double>>"
TRANSCRIPTS = (
    "video_url string, method string, title string, transcription string, summary string, "
    "duration string, language string, word_count int, segments " + SEGMENTS
)
CAPTIONS = "video_url string, items array<struct<text:string,start:double,duration:double>>"
ASR_OUTPUT = "video_url string, text string, language string, segments " + SEGMENTS
VIDEO_REGISTRY = "video_name string, video_url string"
QUESTIONS = "question_id bigint, company_name string, question string"
QA_PAIRS = (
    "session_id bigint, seq int, question string, answer string, "
    "buyer_name string, company_name string"
)
SHARE_PAGES = "page_id bigint, url string, html string"
METADATA = (
    "struct<company:string,video_url:string,chunk_index:int,text:string,start:double,end:double,"
    "title:string,duration:double,language:string,word_count:int,source_type:string,"
    "source:string,original_video_url:string,type:string,context:string>"
)
CHUNK_VECTORS = (
    f"namespace string, id string, embedding array<float>, version bigint, metadata {METADATA}"
)
