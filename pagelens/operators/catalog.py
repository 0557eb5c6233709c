"""Fixed values of the issue table: types, severities and texts.

One entry per issue type in the order the page rules are evaluated, then the asset and site
types: severity, description with `{}` slots, recommendation. "js" marks types that soften
from CRITICAL to WARNING on a script-rendered page.
"""

JS = "js"
JS_NOTE = " (page appears JavaScript-rendered)"

ISSUES = {
    "HTTPS Security": ("CRITICAL", "Page is not served over secure HTTPS.", "Install an SSL certificate and redirect all HTTP traffic to HTTPS."),
    "Missing Title": (JS, "The page is missing a <title> tag.{}", "Create a unique, descriptive <title> tag between 30-65 characters long."),
    "Title Too Short": ("WARNING", "Title tag is very short ({} chars). Titles under 10 chars may not rank well.", "Expand the title to 30-65 characters with relevant keywords."),
    "Title Too Long": ("WARNING", "Title tag length ({} chars) exceeds 65 characters and may be truncated in search results.", "Shorten the title to 65 characters or less to avoid truncation."),
    "Title Special Characters": ("INFO", "Title contains non-ASCII characters: {}. These may display incorrectly in search results.", "Remove or replace special characters with standard ASCII equivalents."),
    "Missing Meta Description": (JS, "The page is missing a meta description tag.{}", "Add a <meta name='description'> tag with a concise summary (50-160 characters)."),
    "Meta Description Too Short": ("WARNING", "Meta description is too short ({} chars). Recommended minimum is 50 characters.", "Expand meta description to 50-160 characters with a compelling summary."),
    "Meta Description Too Long": ("WARNING", "Meta description length ({} chars) exceeds 160 characters and may be truncated.", "Shorten meta description to 160 characters or less."),
    "Multiple Canonical Tags": ("CRITICAL", "Multiple canonical tags found on the page. Search engines may ignore all of them.", "Remove duplicate canonical tags and keep only one with the correct self-referencing URL."),
    "Missing Canonical URL": ("CRITICAL", "Page is missing a canonical link tag.", "Add a <link rel='canonical' href='...'> tag to specify the authoritative version."),
    "Canonical Relative URL": ("WARNING", "Canonical URL uses a relative path instead of absolute URL.", "Use an absolute URL in the canonical href attribute."),
    "Canonical Mismatch": ("WARNING", "Canonical URL '{}' points to a different location than the current page.", "Verify canonical target is correct. If this is the primary page, set self-referencing canonical."),
    "Canonical Protocol Mismatch": ("WARNING", "HTTPS canonical URL on HTTP page.", "Ensure canonical URL uses the same protocol as the page."),
    "Missing Viewport Tag": ("CRITICAL", "Mobile viewport tag is missing. Page is not mobile-responsive.", "Include <meta name='viewport' content='width=device-width, initial-scale=1.0'> in the head."),
    "Viewport Missing Device Width": ("WARNING", "Viewport tag does not include width=device-width.", "Set viewport content to 'width=device-width, initial-scale=1.0'."),
    "Viewport Blocks User Scaling": ("WARNING", "Viewport prevents user scaling (user-scalable=no or maximum-scale=1). This hurts accessibility.", "Allow user scaling by removing user-scalable=no and setting maximum-scale >= 2."),
    "Missing Lang Attribute": ("WARNING", "The <html> tag is missing a valid 'lang' attribute.", "Add a descriptive lang attribute to the root element, e.g. <html lang='en'>."),
    "Missing H1 Heading": (JS, "The page is missing a primary H1 heading tag.{}", "Implement exactly one H1 heading containing the primary subject of the page."),
    "Multiple H1 Headings": ("WARNING", "Multiple H1 tags ({}) were detected.", "Restrict to a single primary H1 tag, nesting subsections inside H2-H6."),
    "Heading Hierarchy Skip": ("INFO", "Heading level skipped: H{} to H{}.", "Use heading levels sequentially (H1 > H2 > H3) without skipping."),
    "JavaScript Rendered Page": ("INFO", "This page appears to be a JavaScript-rendered SPA. Metadata was extracted from OG tags or JS data as fallback.", "Use Server-Side Rendering (SSR) or Static Site Generation (SSG) for better SEO."),
    "Missing Favicon": ("WARNING", "Favicon resource is missing from header definitions.", "Add a favicon link tag: <link rel='icon' href='/favicon.ico'>"),
    "Missing Open Graph Tags": ("WARNING", "Missing Open Graph properties: {}.", "Add og:title, og:description, og:image for proper social sharing."),
    "OG URL Invalid": ("WARNING", "og:url is not an absolute URL: {}", "og:url must be an absolute URL matching the canonical URL."),
    "Missing Twitter Cards": ("WARNING", "Missing Twitter metadata: {}.", "Add twitter:card and twitter:title meta tags."),
    "Invalid JSON-LD": ("CRITICAL", "Schema markup error: {}", "Fix the JSON syntax error in the structured data block."),
    "Schema Missing Required Properties": ("WARNING", "Schema type '{}' is missing required properties: {}", "Add required properties for Google Rich Results: {}"),
    "Missing Alt Text": ("WARNING", "Image is missing an alt description: {}", "Add descriptive, keyword-relevant alt attribute text to this image."),
    "Image Missing Dimensions": ("WARNING", "Image missing width/height attributes (CLS impact): {}", "Add width and height attributes to prevent Cumulative Layout Shift (CLS)."),
    "Images Not Next-Gen Format": ("INFO", "{} images use legacy formats. No WebP/AVIF detected.", "Convert images to WebP or AVIF for 25-50% smaller file sizes."),
    "Images Missing Lazy Loading": ("INFO", "{} images are not lazy loaded.", "Add loading='lazy' to below-the-fold images to improve page load speed."),
    "Internal Nofollow Links": ("WARNING", "{} internal links use rel=nofollow, wasting link equity.", "Remove nofollow from internal links unless specifically needed (e.g. login pages)."),
    "Generic Anchor Text": ("INFO", "{} links use generic anchor text ('click here', 'read more', etc.).", "Replace generic anchors with descriptive text that tells users and search engines what the link target is about."),
    "Empty Anchor Text": ("WARNING", "{} links have no anchor text.", "Add descriptive text between <a> and </a> tags."),
    "Links Missing noopener": ("INFO", "{} links open in new tab without rel=noopener.", "Add rel='noopener' to links with target='_blank' for security."),
    "Noindex Detected": ("WARNING", "Page has noindex directive via {}.", "Remove noindex if this page should be indexed by search engines."),
    "Nofollow Directive Detected": ("WARNING", "Page has nofollow meta robots directive. All outgoing links will not pass PageRank.", "Only use nofollow when linking to untrusted or paid content."),
    "Nosnippet Detected": ("INFO", "Page has nosnippet directive. Search engines won't show a snippet for this page.", "Remove nosnippet unless you want to prevent snippet display in search results."),
    "Hreflang Broken Target": ("WARNING", "Hreflang target {} returns an error.", "Fix or remove hreflang tag pointing to broken URL."),
    "Pagination Detected": ("INFO", "Page has pagination links (next: {}, prev: {}).", "Consider using rel=canonical to the main page or implementing infinite scroll for better indexing."),
    "AMP Page Detected": ("INFO", "Page has AMP alternate: {}", "Ensure AMP page follows Google AMP requirements and has valid structured data."),
    "Redirect Loop": ("CRITICAL", "Page has a redirect loop detected in the redirect chain.", "Fix the redirect chain to avoid circular redirects."),
    "Too Many Redirects": ("WARNING", "Page has {} redirects in chain (max recommended: 3).", "Consolidate redirects to reduce chain length."),
    "Soft 404 Detected": ("CRITICAL", "Page returns HTTP 200 but content appears to be an error page.", "Return proper 404/410 status code for non-existent pages, or fix the content."),
    "Server Error": ("CRITICAL", "Page returned HTTP {} server error.", "Investigate and fix the server-side error causing 5xx responses."),
    "Page Not Found": ("CRITICAL", "Page returned HTTP 404 Not Found.", "Fix the broken URL or set up a proper redirect."),
    "Access Forbidden": ("WARNING", "Page returned HTTP 403 Forbidden.", "Check server permissions and ensure the page is accessible to crawlers."),
    "Slow Response Time": ("WARNING", "Page took {}ms to respond (over 3 seconds).", "Optimize server response time. Target TTFB under 200ms."),
    "High TTFB": ("INFO", "Time to first byte is {}ms (over 1 second).", "Optimize server performance, use CDN, enable caching."),
    "Large Page Size": ("WARNING", "HTML page size is {}KB (over 1MB).", "Reduce page size by minifying HTML, removing unnecessary code."),
    "Deep Page Depth": ("WARNING", "Page is {} clicks from homepage. Important pages should be within 3 clicks.", "Improve internal linking to flatten site architecture."),
    "Broken Link": ("CRITICAL", "Broken {} link: {} (Status: {})", "Update or remove the broken link."),
    "Broken Image": ("CRITICAL", "Broken image: {} (Status: {})", "Fix or remove the broken image source."),
    "Duplicate Page Content": ("WARNING", "{} pages share this content (group {}).", "Set unique content or add canonical/301 redirect to master version."),
    "Duplicate Page Title": ("WARNING", "Duplicate title '{}' shared by {} pages.", "Assign distinct title tags to all pages."),
    "Duplicate Meta Description": ("WARNING", "{} pages share this description: '{}'.", "Create unique meta descriptions for each page."),
    "Orphan Pages": ("WARNING", "{} pages in sitemap have no internal links pointing to them.", "Link these pages internally or remove from sitemap."),
}

# Position of each type in the evaluation order, from 1.
RULE_NUMBER = {name: i for i, name in enumerate(ISSUES, 1)}

SEVERITY_ORDER = "CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'WARNING' THEN 1 WHEN 'INFO' THEN 2 ELSE 3 END"

# Issues of one rule are numbered inside this range: on a page by position, on a site by page order.
# Page orders stay below it (a crawl of a trillion pages).
RULE_STRIDE = 1 << 40
