"""Schemas of landed API pages and of the three result tables."""

from __future__ import annotations

COMMENT_PAGE = """
    nextPageToken string, page_no long, video_id string,
    items array<struct<snippet: struct<
        totalReplyCount: long,
        topLevelComment: struct<snippet: struct<
            authorDisplayName: string, authorChannelId: struct<value: string>,
            textDisplay: string, publishedAt: string, likeCount: long>>>>>
"""

VIDEO_PAGE = """
    video_id string,
    items array<struct<id: string,
        snippet: struct<title: string, publishedAt: string, channelId: string>,
        statistics: struct<viewCount: string, likeCount: string, commentCount: string>>>
"""

FETCH_LOG = "url string, status int, body string"

# Column -> display name, in export order.
METADATA_EXPORT = {
    "video_id": "Video ID",
    "title": "Video Title",
    "published_at": "Video Date",
    "view_count": "Video Views",
    "like_count": "Video Likes",
    "comment_count": "Video Comment Count",
    "url": "Video URL",
    "spam_filtered": "Spam Filtered",
}
COMMENTS_EXPORT = {
    "video_id": "Video ID",
    "author_name": "Author Name",
    "text": "Comment Text",
    "published_at": "Comment Date",
    "like_count": "Comment Likes",
    "reply_count": "Replies",
    "is_creator": "Is Creator",
}
SPAM_EXPORT = {
    "video_id": "Video ID",
    "author_name": "Author Name",
    "text": "Comment Text",
    "published_at": "Comment Date",
    "like_count": "Comment Likes",
    "spam_score": "Spam Score",
    "spam_reason": "Spam Reason",
    "spam_category": "Spam Category",
    "had_obfuscation": "Had Obfuscation",
}
