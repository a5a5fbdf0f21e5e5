"""The relational store: conversations, messages, users, tokens, job states, rate limits, upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """old with the rows of new, less order, in the place of those of the same key and the others added; of rows of one key
    in new the greatest by order is used: found map side first, so a hot key is no burden."""
    columns = [c for c in new.columns if c not in (key, order)]
    last = new.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("_v")).select(key, "_v.*")
    return old.join(last.select(key), key, "left_anti").unionByName(last)


def replace_documents(old: DataFrame, new: DataFrame, key: str = "document_id") -> DataFrame:
    """old without any row of the documents in new, and new: no stale chunk of a document stays."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def conversation_list(conversations: DataFrame, messages: DataFrame, user_id) -> DataFrame:
    """id, title, preview, created_at of a user's conversations, newest first: the last message cut to 120 characters."""
    own = conversations.where(F.col("user_id") == user_id)
    last = messages.join(
        own.select(F.col("id").alias("conversation_id")),
        "conversation_id",
        "left_semi",
    ).groupBy("conversation_id").agg(F.max_by("content", F.struct("created_at", "id")).alias("content"))
    both = own.join(last, own.id == last.conversation_id, "left")
    return both.select("id", F.coalesce("title", F.lit("Untitled")).alias("title"), F.substring("content", 1, 120).alias("preview"), "created_at").orderBy(F.desc("created_at"), F.desc("id"))


def message_history(conversations: DataFrame, messages: DataFrame, user_id, conversation_id) -> DataFrame:
    """Messages of a conversation in order; none where it isn't the user's."""
    own = conversations.where((F.col("user_id") == user_id) & (F.col("id") == conversation_id)).select(F.col("id").alias("conversation_id"))
    return messages.where(F.col("conversation_id") == conversation_id).join(own, "conversation_id", "left_semi").orderBy("created_at", "id")


def delete_conversations(conversations: DataFrame, messages: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the conversations (user_id, id) of gone that are that user's, and their messages."""
    ids = conversations.join(gone, ["user_id", "id"], "left_semi").select("id")
    return conversations.join(ids, "id", "left_anti"), messages.join(ids.select(F.col("id").alias("conversation_id")), "conversation_id", "left_anti")


def turn_pairs(messages: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """conversation, turn, question, answer: each user message and the next one if that's the assistant's."""
    w = W.partitionBy(conversation).orderBy(turn)
    after = messages.withColumn("_r", F.lead(role).over(w)).withColumn("_t", F.lead(text).over(w)).where(F.col(role) == "user")
    return after.select(conversation, turn, F.col(text).alias("question"), F.when(F.col("_r") == "assistant", F.col("_t")).alias("answer"))


def latest_state(events: DataFrame, key: str, at: str, *columns: str, tie: str) -> DataFrame:
    """The last of columns of each key by (at, tie)."""
    return events.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(at, tie)).alias("s")).select(key, "s.*")


def status_precedence(jobs: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """jobs, and those rows of files whose key has no job."""
    return jobs.unionByName(files.join(jobs.select(key).distinct(), key, "left_anti"))


def job_status(states: DataFrame) -> DataFrame:
    """states with pages_done and total_pages only while preprocessing."""
    during = F.col("status") == "preprocessing"
    return states.withColumn("pages_done", F.when(during, F.col("pages_done"))).withColumn("total_pages", F.when(during, F.col("total_pages")))


def rate_limit(hits: DataFrame, key: str, at: str, tie: str, limit: int, seconds: int) -> DataFrame:
    """hits with n, those of the key in the last `seconds` up to this one, rejected ones too, and allowed: n within limit.
    One exactly `seconds` old no longer counts; of hits at one time those after this one by tie don't."""
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    marked = hits.withColumn("_us", micros)
    upto = W.partitionBy(key).orderBy("_us").rangeBetween(-seconds * 1_000_000 + 1, 0)
    peers = W.partitionBy(key, "_us").orderBy(F.desc(tie))
    n = F.count("*").over(upto) - (F.row_number().over(peers) - 1)
    return marked.withColumn("n", n).withColumn("allowed", F.col("n") <= limit).drop("_us")


def add_users(users: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(users with the new ones, those refused because their e-mail, lower-cased and trimmed, is taken)."""
    new = new.withColumn("email", F.lower(F.trim("email")))
    first = new.withColumn("_n", F.row_number().over(W.partitionBy("email").orderBy("id")))
    free = first.where("_n = 1").drop("_n").join(users.select("email"), "email", "left_anti").select(new.columns)
    return users.unionByName(free), new.join(free.select("id"), "id", "left_anti")


def token_hash(token):
    return F.sha2(token.cast("string"), 256)


def rotate_tokens(tokens: DataFrame, asked: DataFrame, now) -> DataFrame:
    """tokens (token_hash, user_id, expires_at) after requests (token, new_token, expires_at): a request with a live token
    takes it out and puts the new one in; others change nothing. Of requests with one token the first by new_token counts."""
    known = asked.select(token_hash(F.col("token")).alias("token_hash"), token_hash(F.col("new_token")).alias("new_hash"), F.col("expires_at").alias("new_expiry"))
    known = known.groupBy("token_hash").agg(F.min_by(F.struct("new_hash", "new_expiry"), "new_hash").alias("_v")).select("token_hash", "_v.*")
    live = tokens.where(F.col("expires_at") >= now).join(known, "token_hash")
    fresh = live.select(F.col("new_hash").alias("token_hash"), "user_id", F.col("new_expiry").alias("expires_at"))
    return tokens.join(live.select("token_hash"), "token_hash", "left_anti").unionByName(fresh)


def log_out(tokens: DataFrame, asked: DataFrame) -> DataFrame:
    """tokens without those of asked (token)."""
    return tokens.join(asked.select(token_hash(F.col("token")).alias("token_hash")), "token_hash", "left_anti")


def active_users(users: DataFrame, asked: DataFrame) -> DataFrame:
    """The active users among users (id, is_active) that asked (id) names; a user without the flag is none."""
    return users.where(F.coalesce("is_active", F.lit(False))).join(asked.select("id").distinct(), "id", "left_semi")


def outside_sign_in(users: DataFrame, signed: DataFrame) -> DataFrame:
    """users (id, email, oauth_provider, oauth_sub) after sign-ins with a provider (same columns): a known e-mail, lower-cased
    and trimmed, gets the provider and name where it had none; others are added, one row an e-mail, the first by id."""
    new = signed.withColumn("email", F.lower(F.trim("email")))
    new = new.groupBy("email").agg(F.min_by(F.struct("id", "oauth_provider", "oauth_sub"), "id").alias("_v")).select("_v.id", "email", "_v.oauth_provider", "_v.oauth_sub")
    n = new.select("email", F.col("oauth_provider").alias("_p"), F.col("oauth_sub").alias("_s"))
    kept = users.join(n, "email", "left").withColumns({"oauth_provider": F.coalesce("oauth_provider", "_p"), "oauth_sub": F.coalesce("oauth_sub", "_s")}).select(users.columns)
    return kept.unionByName(new.join(users.select("email"), "email", "left_anti"), allowMissingColumns=True)


def asked_in_conversations(conversations: DataFrame, messages: DataFrame, asked: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(conversations, messages, refused) after questions asked (request_id, user_id, question, conversation_id, created_at)
    and answers (request_id, answer, answered_at).

    A request without a conversation opens one of its request's name, titled by the first 120 characters; one that names a
    conversation which isn't its user's is refused and leaves no trace. Each other request adds the user's message, and the
    assistant's after it where there's an answer: a question whose answer failed stays. conversations: (id, user_id, title,
    created_at); messages: (id, conversation_id, role, content, created_at)."""
    own = conversations.select(F.col("id").alias("conversation_id"), F.col("user_id").alias("_owner"))
    known = asked.join(own, "conversation_id", "left")
    fine = F.col("conversation_id").isNull() | F.coalesce(F.col("_owner") == F.col("user_id"), F.lit(False))
    refused = known.where(~fine).select(asked.columns)
    ok = known.where(fine).withColumn("_conversation", F.coalesce("conversation_id", object_uuid(F.col("request_id"))))
    opened = ok.where("conversation_id is null").select(F.col("_conversation").alias("id"), "user_id", F.substring("question", 1, 120).alias("title"), "created_at")
    said = ok.select(
        object_uuid(F.concat(F.lit("user:"), "request_id")).alias("id"),
        F.col("_conversation").alias("conversation_id"),
        F.lit("user").alias("role"),
        F.col("question").alias("content"),
        "created_at",
    )
    told = ok.join(answers, "request_id").select(
        object_uuid(F.concat(F.lit("assistant:"), "request_id")).alias("id"),
        F.col("_conversation").alias("conversation_id"),
        F.lit("assistant").alias("role"),
        F.col("answer").alias("content"),
        F.col("answered_at").alias("created_at"),
    )
    return conversations.unionByName(opened), messages.unionByName(said).unionByName(told), refused


def scoped_to_user(rows: DataFrame, user_id) -> DataFrame:
    """The rows of a user's own corpus: a user's documents and index lie in the partition of their id."""
    return rows.where(F.col("user_id") == user_id)


def valid_request(question, top_k):
    """Whether a request can be served: a question of a character or more, and 1 to 20 passages."""
    return F.coalesce((F.length(question) >= 1) & top_k.between(1, 20), F.lit(False))


def recency(at, now):
    """Today, Yesterday, so many days ago within a week, else the date."""
    days = F.floor((F.unix_millis(now) - F.unix_millis(at)) / 86_400_000)
    return F.when(days == 0, "Today").when(days == 1, "Yesterday").when(days < 7, F.concat(days.cast("string"), F.lit(" days ago"))).otherwise(F.date_format(at, "yyyy-MM-dd"))


def object_uuid(name):
    """The md5 of a name written as a UUID."""
    h = F.md5(name.cast("string"))
    cut = lambda a, n: F.substring(h, a, n)
    return F.concat_ws("-", cut(1, 8), cut(9, 4), cut(13, 4), cut(17, 4), cut(21, 12))


def question_sample(chunks: DataFrame, key: str, text: str, n: int, seed: int = 42) -> DataFrame:
    """n of the longest max(3n, half and one) chunks, ties in length by key; always the same."""
    pool = F.greatest(F.lit(3 * n), F.floor(F.col("_total") / 2) + 1)
    total = chunks.agg(F.count("*").alias("_total"))  # one row
    # ranks by length from counts of each length, so that the pool is cut without sorting the table in one task
    sized = chunks.withColumn("_len", F.length(F.coalesce(text, F.lit(""))))
    by = sized.groupBy("_len").agg(F.count("*").alias("_c")).withColumn("_before", F.coalesce(F.sum("_c").over(W.orderBy(F.desc("_len")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    near = sized.join(by, "_len").join(F.broadcast(total)).where(F.col("_before") < pool)
    edge = near.withColumn("_at", F.row_number().over(W.partitionBy("_len").orderBy(key))).where(F.col("_before") + F.col("_at") <= pool)
    return deterministic_sample(edge, key, n, seed).select(chunks.columns)


def deterministic_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows, always the same, by a hash of key and seed."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)
