"""The derived works and sections of a scale-factor folder."""

from quire import views
from quire.registry import table


def works_v(spark, d):
    return views.document_works(table(spark, d, "documents"))


def sections_v(spark, d):
    return views.document_sections(table(spark, d, "documents"))


def works_c(spark, d):
    return views.conversation_works(table(spark, d, "conversations"))


def sections_c(spark, d):
    return views.conversation_sections(table(spark, d, "conversations"))
